"""Discovery over one table: seeds without chance, gates, islands, and rounds until nothing is accepted.

A state is an expression with its metrics by domain.  Metrics of all candidates of a round come from one pass over the
whole table (`evaluation`); gates are Columns over rows (island, new, old), so a round decides on all islands at once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.operators import evaluation, gram, residual, search
from quillon.operators.ranking import log_metric
from quillon.operators.residual import intermediate_outputs  # noqa: F401

INF = float("inf")
METRICS = ("val_nmse", "val_strict", "val_p99", "val_p995", "stress_nmse", "stress_strict", "stress_p99", "ood_nmse", "ood_strict", "ood_penalty", "complexity")
METRIC_TYPE = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ",digest:string>"
# What may not get worse, the weights of the accuracy gain, and of each island's score.
SAFE = ("val_nmse", "val_strict", "val_p99", "val_p995", "stress_nmse", "stress_strict", "stress_p99", "ood_nmse", "ood_strict")
SAFE_DOMINANCE = ("val_nmse", "stress_nmse", "stress_p99", "ood_nmse")
GAIN = (("val_nmse", 0.45), ("val_p99", 0.125), ("val_strict", 0.125), ("stress_nmse", 0.10), ("stress_p99", 0.10), ("ood_nmse", 0.05), ("ood_strict", 0.05))
COMMON = {"val_nmse": 2.5, "stress_nmse": 0.7, "ood_nmse": 0.5, "ood_penalty": 0.15}
ISLANDS = {
    "balanced": ({"val_p99": 0.65, "val_strict": 0.35}, 0.020), "nmse": ({"val_p99": 0.25}, 0.010), "tail": ({"val_strict": 1.50, "val_p99": 1.20, "stress_p99": 0.70}, 0.012),
    "low_complexity": ({"val_p99": 0.25}, 0.050), "novelty": ({"val_p99": 0.40}, 0.015),
}
PHASES = ("INITIALIZE", "SEED", "DETERMINISTIC_EXPLORE", "SELECT", "COMPLETE")


@dataclass(frozen=True)
class Policy:
    """Limits of the gates."""

    tolerance: float = 0.01
    final_tolerance: float = 0.005
    least_gain: float = 0.01
    complexity_penalty: float = 0.20
    max_complexity: float = 160.0
    warning_cap: float = 1.25
    val_strict: float | None = None
    stress_strict: float | None = None
    max_rounds: int = 3
    islands: tuple[str, ...] = tuple(ISLANDS)


def finite(m: Column) -> Column:
    return reduce(lambda a, b: a & b, [m[k].isNotNull() & ~F.isnan(m[k]) & (F.abs(m[k]) < INF) for k in METRICS])


def non_worse(new: Column, old: Column, tolerance: float) -> Column:
    return new <= old * (1 + tolerance) + 1e-12


def accuracy_gain(new: Column, old: Column) -> Column:
    """Weighted sum of one less the ratios of new errors to old ones."""
    return sum((F.lit(w) * (1 - new[k] / F.greatest(F.abs(old[k]), F.lit(1e-15))) for k, w in GAIN), F.lit(0.0))


def complexity_cost(new: Column, old: Column, policy: Policy) -> Column:
    """Added complexity over a local budget, 1 at most."""
    budget = F.greatest(F.lit(8.0), F.least(F.lit(policy.max_complexity), old["complexity"] + 16))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), new["complexity"] - old["complexity"]) / budget)


def island_score(m: Column, island: Column, changed: Column | None = None, added: Column | None = None) -> Column:
    """Score of a state in an island, less is better.  changed, added: a structure other than the island's, and how many nodes it added."""
    common = sum((F.lit(w) * log_metric(m[k]) for k, w in COMMON.items()), F.lit(0.0))
    out = F.lit(None).cast("double")
    for name, (more, size) in ISLANDS.items():
        s = sum((F.lit(w) * log_metric(m[k]) for k, w in more.items()), common) + F.lit(size) * m["complexity"]
        if name == "novelty" and changed is not None:
            s = s - F.when(changed, 0.30 + 0.03 * (added if added is not None else F.lit(0))).otherwise(0.0)
        out = F.when(island == name, s).otherwise(out)
    return F.when(finite(m), out).otherwise(INF)


def penalty_holds(new: Column, old: Column, policy: Policy, tolerance: float) -> Column:
    """The extrapolation warning stays under its cap or about where it was."""
    return new["ood_penalty"] <= F.greatest(F.lit(policy.warning_cap), old["ood_penalty"] * (1 + tolerance) + 1e-12)


def dominates(new: Column, old: Column, policy: Policy, final: bool = False) -> Column:
    """Whether a state beats another: nothing of safety is worse, and the gain pays for the structure it adds."""
    tolerance = min(policy.tolerance, policy.final_tolerance) if final else policy.tolerance
    safe = reduce(lambda a, b: a & b, [non_worse(new[k], old[k], tolerance) for k in SAFE_DOMINANCE]) & penalty_holds(new, old, policy, tolerance)
    gain, cost = accuracy_gain(new, old), policy.complexity_penalty * complexity_cost(new, old, policy)
    worth = (gain - cost >= policy.least_gain) | (new["complexity"] < old["complexity"])
    out = finite(new) & safe & worth & (gain >= cost - 1e-12) & (new["complexity"] <= policy.max_complexity) & (new["digest"] != old["digest"])
    for k, most in (("val_strict", policy.val_strict), ("stress_strict", policy.stress_strict)):
        if final and most is not None:
            out = out & (new[k] <= most + 1e-12)
    return F.coalesce(out, F.lit(False))


def accepts(new: Column, old: Column, island: Column, policy: Policy, added: Column | None = None) -> Column:
    """Whether an island goes over to a state: all of safety holds, and its score or the gain net of complexity improves by least_gain."""
    safe = reduce(lambda a, b: a & b, [non_worse(new[k], old[k], policy.tolerance) for k in SAFE]) & penalty_holds(new, old, policy, policy.tolerance)
    changed = new["digest"] != old["digest"]
    before, after = island_score(old, island), island_score(new, island, changed, added)
    relative = (before - after) / F.greatest(F.abs(before), F.lit(1e-12))
    rescue = accuracy_gain(new, old) - policy.complexity_penalty * complexity_cost(new, old, policy)
    good = finite(new) & (new["complexity"] <= policy.max_complexity) & safe & changed & ((relative >= policy.least_gain) | (rescue >= policy.least_gain))
    return F.coalesce(good, F.lit(False))


@dataclass(frozen=True)
class State:
    expression: str
    digest: str
    metrics: dict[str, float] = field(hash=False, default_factory=dict)
    source: str = ""

    @property
    def row(self) -> tuple:
        return (*[float(self.metrics[m]) for m in METRICS], self.digest)

    @property
    def finite(self) -> bool:
        return all(self.metrics[m] is not None and abs(self.metrics[m]) < INF for m in METRICS)


def evaluated(domains: evaluation.Domains, texts: list[tuple[str, str]]) -> list[State | None]:
    """The states of (expression, source) pairs, in order, all from one pass; None for what can't be read."""
    d, digests = domains.features, {}
    for text, _ in texts:
        try:
            digests[text] = ex.digest(text, d)
            ex.compile_expression(text, [F.lit(1.0)] * d)
        except (ValueError, SyntaxError, ZeroDivisionError, OverflowError):
            digests.pop(text, None)
    readable = [t for t in dict.fromkeys(t for t, _ in texts) if t in digests]
    got = dict(zip(readable, evaluation.metric_vectors(domains, readable), strict=True))
    return [State(t, digests[t], {k: float(got[t][k]) for k in METRICS}, source) if t in got else None for t, source in texts]


def evaluate(train: DataFrame, valid: DataFrame, text: str, xs: list[Column], y: Column, source: str = "") -> State | None:
    """The state of one expression; None if it can't be read."""
    return evaluated(evaluation.prepare(train, valid, xs, y), [(text, source)])[0]


def deterministic_candidates(train: DataFrame, xs: list[Column], y: Column, alpha: float = 1e-8) -> list[tuple[str, str]]:
    """(expression, source): the mean, sparse fits of a generic basis at five sizes, and a linear fit; all from one aggregate."""
    terms = {"intercept": ("1", F.lit(1.0))} | search.anchor_terms(xs)
    s = gram.gram(train, {k: c for k, (_, c) in terms.items()}, y)
    d, n = len(xs), len(terms) - 1

    def spell(names: tuple[str, ...], beta) -> str:
        return " + ".join(f"{float(b)!r}*({terms[t][0]})" for t, b in zip(names, beta, strict=True))

    out = [(f"({float(s.xy[0] / s.n)!r})", "constant")]
    for keep in sorted({max(2, d + 1), max(4, 2 * d + 2), *(min(k, max(4, n)) for k in (12, 24, 40))}):
        out.append((spell(*gram.sparse_terms(s, keep, alpha)), f"sparse_{keep}"))
    linear = ("intercept", *[f"x{i}" for i in range(d)])
    return [*out, (spell(linear, gram.ridge(s.of(linear), alpha)), "linear")]


def scored(spark, states: list[State], island: str) -> list[State]:
    """Finite states by their score in an island, best first; ties by expression."""
    if not states:
        return []
    rows = spark.createDataFrame([(k, s.row) for k, s in enumerate(states)], f"k int, m {METRIC_TYPE}")
    got = rows.select("k", island_score(F.col("m"), F.lit(island)).alias("s")).collect()
    return [states[k] for _, _, k in sorted((r.s, states[r.k].expression, r.k) for r in got)]


def front(states: list[State]) -> list[State]:
    """States that no other is at least as good as in every metric and better in one."""

    def beats(a: State, b: State) -> bool:
        x, y = a.row[:-1], b.row[:-1]
        return all(p <= q + 1e-12 for p, q in zip(x, y, strict=True)) and any(p < q - 1e-12 for p, q in zip(x, y, strict=True))

    return [s for s in states if s.finite and not any(beats(o, s) for o in states)]


def seed_survivor(train: DataFrame, valid: DataFrame, seeds: list[tuple[str, str]], xs: list[Column], y: Column, budget: search.Budget | None = None, domains: evaluation.Domains | None = None) -> tuple[State, list[State]]:
    """The seed of least balanced score on the front, and all that could be evaluated; a generic sparse fit if none could."""
    domains = domains or evaluation.prepare(train, valid, xs, y)

    def tried(texts: list[tuple[str, str]]) -> list[State]:
        allowed = [t for t in texts if t[0].strip() and (budget is None or budget.consume("seed"))]
        return [s for s in evaluated(domains, allowed) if s is not None and s.finite]

    states = tried(seeds)
    if not states and (budget is None or sum(budget.used.values()) < budget.most):
        states = tried([c for c in deterministic_candidates(train, xs, y) if c[1].startswith("sparse")][:1])
    if not states:
        raise ValueError("no seed could be evaluated within the budget")
    spark = train.sparkSession
    return scored(spark, front(states) or states, "balanced")[0], scored(spark, states, "balanced")


def validate_batch(rows: DataFrame, column: str, request_id: str, most: int) -> DataFrame:
    """(candidate_id, expression, reject_reason): proposals of a JSON batch {request_id, candidates: [{candidate_id, expression}]}, judged one by one."""
    kind = "struct<request_id:string,candidates:array<struct<candidate_id:string,expression:string>>>"
    b = rows.select(F.from_json(column, kind).alias("b")).select("b.request_id", F.posexplode("b.candidates").alias("at", "c"))
    first = b.groupBy("c.candidate_id").agg(F.min("at").alias("first"))
    d = b.select("request_id", "at", "c.candidate_id", "c.expression").join(first, "candidate_id", "left")
    reason = (
        F.when(F.col("request_id").isNull() | (F.col("request_id") != request_id), "wrong_request").when(F.col("at") >= most, "over_count").when(F.coalesce(F.trim("candidate_id"), F.lit("")) == "", "no_id")
        .when(F.col("at") > F.col("first"), "repeated_id").when(F.coalesce(F.trim("expression"), F.lit("")) == "", "no_expression")
    )
    return d.select("candidate_id", "expression", reason.alias("reject_reason"))


def public_fields(metadata: dict, allowed: tuple[str, ...]) -> dict:
    """The allowed fields of a mapping, in their order."""
    return {k: metadata[k] for k in allowed if k in metadata}


class Events:
    """An append-only list of phase events; phases never go back."""

    def __init__(self, write: Callable[[dict], None] | None = None):
        self.rows: list[dict] = []
        self.write = write

    def add(self, phase: str, event: str, round_id: int, /, **payload) -> dict:
        if phase not in PHASES:
            raise ValueError(f"unknown phase {phase}")
        if self.rows and PHASES.index(phase) < PHASES.index(self.rows[-1]["phase"]):
            raise ValueError(f"{phase} can't follow {self.rows[-1]['phase']}")
        payload.pop("round_id", None)
        row = {"seq": len(self.rows), "phase": phase, "event": event, "round_id": round_id, **payload}
        self.rows.append(row)
        if self.write is not None:
            self.write(row)
        return row


#: How many terms an island may add to its state in a round.
ADDED = {"low_complexity": 2, "nmse": 5, "tail": 4, "novelty": 4}


def proposals(train: DataFrame, state: State, xs: list[Column], y: Column, island: str) -> str:
    """The island's candidate: the state corrected by what the residual grammar finds under the island's profile; the first terms of a generic basis where the state doesn't vary."""
    try:
        return residual.program(train, state.expression, xs, y, island, residual.Settings(beam=8, most_terms=64, chosen=ADDED.get(island, 3)))["expression"]
    except ValueError:
        found = search.explore(train, xs, y - ex.compile_expression(state.expression, xs), beam=ADDED.get(island, 3) - 1)
        return f"({state.expression}) + {found['expression']}"


def discover(train: DataFrame, valid: DataFrame, xs: list[Column], y: Column, policy: Policy | None = None, seeds: list[tuple[str, str]] | None = None, budget: search.Budget | None = None, write: Callable[[dict], None] | None = None) -> dict:
    """Seeds, then rounds in which every island may go over to one candidate, until none does or max_rounds; a report."""
    policy, events = policy or Policy(), Events(write)
    spark = train.sparkSession
    events.add("INITIALIZE", "started", 0, features=len(xs))
    domains = evaluation.prepare(train, valid, xs, y)
    anchor, tried = seed_survivor(train, valid, seeds or deterministic_candidates(train, xs, y), xs, y, budget, domains)
    events.add("SEED", "anchor_selected", 0, expression=anchor.expression)
    islands, accepted = dict.fromkeys(policy.islands, anchor), []
    for round_id in range(1, policy.max_rounds + 1):
        allowed = []
        for island in islands:
            if budget is not None and not budget.consume("exploration"):
                break
            allowed.append(island)
        texts = [(proposals(train, islands[k], xs, y, k), f"round_{round_id}_{k}") for k in allowed]
        new = {k: s for k, s in zip(allowed, evaluated(domains, texts), strict=True) if s is not None and s.finite}
        passed = []
        if new:
            rows = spark.createDataFrame([(k, s.row, islands[k].row) for k, s in new.items()], f"island string, new {METRIC_TYPE}, old {METRIC_TYPE}")
            passed = [r.island for r in rows.where(accepts(F.col("new"), F.col("old"), F.col("island"), policy)).orderBy("island").collect()]
        for k in passed:
            islands[k] = new[k]
            accepted.append(new[k])
        events.add("DETERMINISTIC_EXPLORE", "round_completed", round_id, accepted=passed, candidates={k: s.expression for k, s in new.items()}, fixed_point=not passed)
        if not passed:
            break
    states = list({s.digest: s for s in (anchor, *accepted, *islands.values())}.values())
    survivor = scored(spark, front(states) or states, "balanced")[0]
    events.add("SELECT", "survivor_selected", events.rows[-1]["round_id"], expression=survivor.expression)
    return report(anchor, survivor, tried, accepted, islands, events, budget)


def report(anchor: State, survivor: State, tried: list[State], accepted: list[State], islands: dict[str, State], events: Events, budget: search.Budget | None) -> dict:
    """What a run did, as values that JSON holds."""
    events.add("COMPLETE", "reported", events.rows[-1]["round_id"])
    out = {
        "anchor": asdict(anchor), "survivor": asdict(survivor), "seeds": [s.expression for s in tried], "lineage": [s.expression for s in accepted], "islands": {k: s.expression for k, s in sorted(islands.items())},
        "rounds": sum(e["phase"] == "DETERMINISTIC_EXPLORE" for e in events.rows), "events": events.rows, "budget": budget.snapshot() if budget else None,
    }
    return json.loads(json.dumps(out, default=str).replace("Infinity", "null"))
