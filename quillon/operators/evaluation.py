"""The whole metric vector of expressions: train, validation, stress folds, rows outside the training range, and far probes.

What doesn't depend on an expression (folds, the outside rows, ranges, scales) is worked out once and written with the
rows; then all expressions of a round are judged together: one aggregate gives errors, maxima and shares of
every domain, and a bound for each tail; the rows beyond the bounds, some two in a hundred, give the exact quantiles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import expressions as ex
from quillon.functions.columns import finite, seeded_hex, uniform
from quillon.operators.metrics import safe_corr
from quillon.operators.ordered import quantiles, ranked, ranked_by_hex
from quillon.sources.shared import removed, written

FIELDS = ("train_nmse", "val_nmse", "val_strict", "val_p99", "val_p995", "val_share", "stress_nmse", "stress_strict", "stress_p99", "ood_nmse", "ood_strict", "ood_penalty", "complexity", "invalid")
#: Share of a domain below its tail's bound, how exact the bound's rank is, and the rows up to which there is no bound.
BELOW, ACCURACY, WHOLE = 0.98, 10_000, 1000
# Fixed values of the outside rule and of the probe.
OUTSIDE_SHARE, OUTSIDE_LEAST, FARTHEST, STEP = 0.05, 4, 0.2, 1e-4


@dataclass(frozen=True)
class Config:
    """Folds of the stress domain, floors of relative errors (absolute, and as a share of the domain's scale), probes."""

    folds: int = 6
    seed: int = 0
    floor_abs: float = 1e-12
    floor_ratio: float = 0.0
    probes: int = 128


@dataclass(frozen=True)
class Domains:
    """Rows with their domains, and what expressions need beside them."""

    rows: DataFrame
    features: int
    floors: dict[str, float]
    probe: DataFrame
    y_scale: float


def split(rank: Column, n: int, parts: int) -> Column:
    """The part of a rank when n places are cut into parts whose sizes differ by one at most, larger ones first."""
    size, more = divmod(n, parts)
    return F.when(rank < more * (size + 1), F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - more * (size + 1)) / max(size, 1))).cast("int")


def prepare(train: DataFrame, valid: DataFrame, xs: list[Column], y: Column, ident: Column | None = None, config: Config | None = None) -> Domains:
    """Domains of two tables with the same columns.

    ident: distinct integers, which settle ties and folds; a hash of the row where None.  Stress folds: half of them
    by rank of a seeded digest, half by rank of |y|.  Outside: validation rows beyond the .05 and .95 quantiles of the
    training rows in any feature; where these are few, the farthest fifth by the largest scaled distance from the medians,
    of equal ones the larger ids.
    """
    config = config or Config()
    d = len(xs)
    names = [f"_x{k}" for k in range(d)]
    key = ident if ident is not None else F.xxhash64(*xs, y)
    cut = [t.select(key.cast("long").alias("_id"), *[x.cast("double").alias(n) for x, n in zip(xs, names, strict=True)], y.cast("double").alias("_y"), F.lit(role).alias("_role")) for role, t in (("train", train), ("val", valid))]
    rows = written(cut[0].unionByName(cut[1]), "evaluated")
    row = rows.agg(F.count(F.lit(1)), F.sum((F.col("_role") == "val").cast("long")), F.var_pop("_y")).first()
    n, n_valid, var = row[0], row[1] or 0, row[2] or 0.0
    if n == n_valid or not n_valid:
        raise ValueError("both training and validation rows are needed")
    groups = [(f"all{k}", F.col(c)) for k, c in enumerate(names)] + [("y", F.abs("_y"))] + [(f"train{k}", F.when(F.col("_role") == "train", F.col(c))) for k, c in enumerate(names)]
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(g).alias("g"), v.alias("v")) for g, v in groups])).alias("e")).select("e.g", "e.v")
    q: dict[str, dict[float, float]] = {}
    for r in quantiles(long, F.col("v"), [0.05, 0.5, 0.95], ["g"]).collect():
        q.setdefault(r.g, {})[r.level] = r.q

    inside = [(q[f"train{k}"], F.col(c)) for k, c in enumerate(names)]
    extreme = reduce(lambda a, b: a | b, [(c < lv[0.05]) | (c > lv[0.95]) for lv, c in inside])
    distances = [F.abs((c - lv[0.5]) / max(lv[0.95] - lv[0.05], 1e-12)) for lv, c in inside]
    distance = F.greatest(*distances) if d > 1 else distances[0]
    is_valid = F.col("_role") == "val"
    n_extreme = rows.where(is_valid & extreme).count()
    if n_extreme < max(OUTSIDE_LEAST, int(OUTSIDE_SHARE * n_valid)):
        count = min(n_valid, max(OUTSIDE_LEAST, math.ceil(FARTHEST * n_valid)))
        far = ranked(rows.where(is_valid).withColumn("_far", distance), F.col("_far"), "_id", "_rank").where(F.col("_rank") >= n_valid - count)
        rows = rows.join(far.select("_id", F.lit(True).alias("_out")), "_id", "left").withColumn("_out", F.coalesce("_out", F.lit(False)) & is_valid)
    else:
        rows = rows.withColumn("_out", is_valid & extreme)

    kinds = [F.col("_role"), F.lit("all"), F.when(F.col("_out"), F.lit("ood"))]
    if n >= 4:
        by_digest = min(max(2, config.folds // 2), n)
        by_size = min(max(2, config.folds - by_digest), n)
        rows = ranked_by_hex(rows.withColumn("_hex", seeded_hex(config.seed, F.col("_id").cast("string"))), "_hex", "_r")
        rows = ranked(rows.withColumn("_a", F.abs("_y")), F.col("_a"), "_id", "_o")
        kinds += [F.concat(F.lit("r"), split(F.col("_r"), n, by_digest)), F.concat(F.lit("o"), split(F.col("_o"), n, by_size))]
    rows = written(rows.select("_id", *names, "_y", F.array_compact(F.array(*kinds)).alias("_domains")), "domains")

    floors: dict[str, float] = {}
    if config.floor_ratio > 0:
        each = rows.select("_y", F.explode("_domains").alias("g"))
        top = {r.g: r.q for r in quantiles(each, F.abs("_y"), [0.95], ["g"]).collect()}
        for r in each.groupBy("g").agg(F.stddev_pop("_y").alias("s")).collect():
            floors[r.g] = max(config.floor_abs, config.floor_ratio * max(top[r.g], r.s, 1e-12))
    floors = {"": config.floor_abs} | floors

    spread = [max(q[f"all{k}"][0.95] - q[f"all{k}"][0.05], 1e-9) for k in range(d)]
    ids = train.sparkSession.range(min(max(16, config.probes), max(16, n)))

    def chance(k: int, what: str) -> Column:
        return uniform(seeded_hex(config.seed, F.concat_ws(":", F.col("id").cast("string"), F.lit(str(k)), F.lit(what))))

    places = [F.lit(q[f"all{k}"][0.5]) + F.when(chance(k, "sign") < 0.5, -1.0).otherwise(1.0) * (0.75 + 0.75 * chance(k, "size")) * spread[k] for k in range(d)]
    probe = ids.select(*[p.alias(c) for p, c in zip(places, names, strict=True)], *[(p + STEP * s).alias(f"_near{k}") for k, (p, s) in enumerate(zip(places, spread, strict=True))])
    return Domains(rows, d, floors, written(probe.coalesce(1), "probe"), max(q["y"][0.95], math.sqrt(max(var, 1e-15)), 1e-9))


def _tails(frame: DataFrame, asked: dict[tuple[str, int], list[float]], sizes: dict[str, int], bounds: dict[tuple[str, int], float], values: Column, over: Column) -> dict[tuple[str, int, float], float]:
    """Exact quantiles of upper tails: (domain, expression, level) to value.  values: a column of arrays by expression; over: what they are divided by, by row and domain g."""
    if not asked:
        return {}
    spark = frame.sparkSession
    low = spark.createDataFrame([(g, k, -math.inf if sizes[g] <= WHOLE else bounds[g, k]) for g, k in asked], "g string, k int, low double")
    d = frame.select("_id", "_y", F.explode("_domains").alias("g"), values.alias("_v")).where(F.col("g").isin(sorted({g for g, _ in asked})))
    d = d.select("_id", "g", over.alias("_over"), F.posexplode("_v").alias("k", "v")).withColumn("v", F.col("v") / F.col("_over")).join(F.broadcast(low), ["g", "k"]).where("v >= low").select("_id", "g", "k", "v")
    places = [(g, k, level, side, sizes[g] - 1 - int(f(level * (sizes[g] - 1)))) for (g, k), levels in asked.items() for level in levels for side, f in ((0, math.floor), (1, math.ceil))]
    at = spark.createDataFrame(places, "g string, k int, level double, side int, from_top long")
    got = ranked(d, -F.col("v"), "_id", "from_top", ["g", "k"]).join(F.broadcast(at), ["g", "k", "from_top"]).select("g", "k", "level", "side", "v").collect()
    ends = {(r.g, r.k, r.level, r.side): r.v for r in got}
    out = {}
    for (g, k), levels in asked.items():
        for level in levels:
            a, b, place = ends[g, k, level, 0], ends[g, k, level, 1], level * (sizes[g] - 1)
            out[g, k, level] = a + (place - math.floor(place)) * (b - a)
    return out


def metric_vectors(domains: Domains, texts: list[str]) -> list[dict[str, float]]:
    """The metric vector of each expression, in order; all infinite, and invalid 1, where it isn't a number on some row."""
    if not texts:
        return []
    names = [F.col(f"_x{k}") for k in range(domains.features)]
    y = F.col("_y")
    floor = F.coalesce(F.create_map(*[F.lit(v) for kv in domains.floors.items() for v in kv])[F.col("g")], F.lit(domains.floors[""]))
    made: list[str] = []
    # Predictions are made once: three passes read them, and inside an aggregate each use would repeat its expression.
    frame = written(domains.rows.withColumn("_p", F.array(*[ex.compile_expression(t, names).cast("double") for t in texts])), "predicted", made)
    each = frame.select(F.explode("_domains").alias("g"), "_y", "_p").withColumn("_f", F.greatest(F.abs(y), floor))
    aggs = [F.count(F.lit(1)).alias("n"), F.greatest(F.var_pop("_y"), F.lit(1e-15)).alias("var")]
    for k in range(len(texts)):
        p = F.get("_p", F.lit(k))
        rel = F.abs(p - y) / F.col("_f")
        aggs.append(F.struct(
            F.bool_and(finite(p)).alias("ok"), F.avg((p - y) * (p - y)).alias("mse"), F.max(rel).alias("strict"), F.avg((rel <= 0.1).cast("int")).alias("share"),
            F.percentile_approx(rel, BELOW, ACCURACY).alias("rel"), F.percentile_approx(F.abs(p), BELOW, ACCURACY).alias("size"),
        ).alias(f"e{k}"))
    got = {r.g: r for r in each.groupBy("g").agg(*aggs).collect()}
    sizes = {g: r.n for g, r in got.items()}
    good = [k for k in range(len(texts)) if got["all"][f"e{k}"].ok]
    stress = sorted(g for g in got if g[0] in "ro" and g != "ood") or ["all"]
    rel_asked = {(g, k): [0.99, 0.995] if g == "val" else [0.99] for k in good for g in ["val", *stress]}
    bounds = {(g, k): got[g][f"e{k}"].rel for g, k in rel_asked}
    rel_tails = _tails(frame, rel_asked, sizes, bounds, F.transform(F.col("_p"), lambda p: F.abs(p - y)), F.greatest(F.abs(y), floor))
    size_asked = {("all", k): [0.99] for k in good}
    size_tails = _tails(frame, size_asked, sizes, {("all", k): got["all"][f"e{k}"].size for k in good}, F.transform(F.col("_p"), F.abs), F.lit(1.0))
    nears = [F.col(f"_near{k}") for k in range(domains.features)]
    probed = domains.probe.select(*[c.cast("double").alias(f"{w}{k}") for k in good for w, c in (("far", ex.compile_expression(texts[k], names)), ("near", ex.compile_expression(texts[k], nears)))]).collect() if good else []
    removed(frame.sparkSession, made)
    out = []
    for k, t in enumerate(texts):
        if k not in good:
            out.append(dict.fromkeys(FIELDS, math.inf) | {"val_share": 0.0, "invalid": 1.0})
            continue
        m = {g: r[f"e{k}"].mse / r.var for g, r in got.items()}
        far, near = (np.array([math.nan if r[f"{w}{k}"] is None else r[f"{w}{k}"] for r in probed]) for w in ("far", "near"))
        out.append({
            "train_nmse": m["train"], "val_nmse": m["val"], "val_strict": got["val"][f"e{k}"].strict, "val_p99": rel_tails["val", k, 0.99], "val_p995": rel_tails["val", k, 0.995], "val_share": got["val"][f"e{k}"].share,
            "stress_nmse": max(m[g] for g in stress), "stress_strict": max(got[g][f"e{k}"].strict for g in stress), "stress_p99": max(rel_tails[g, k, 0.99] for g in stress),
            "ood_nmse": m["ood"], "ood_strict": got["ood"][f"e{k}"].strict, "ood_penalty": penalty(far, near, size_tails["all", k, 0.99], domains.y_scale), "complexity": float(ex.complexity(t, domains.features)), "invalid": 0.0,
        })
    return out


def penalty(far: np.ndarray, near: np.ndarray, observed: float, y_scale: float) -> float:
    """Warning of far extrapolation: how much larger than on the rows it gets, over a factor of 2, and how steep, over 1e5; logarithms.  Infinite where a probe isn't a number."""
    if not (np.isfinite(far).all() and np.isfinite(near).all()):
        return math.inf
    size = float(np.quantile(np.abs(far), 0.99)) / y_scale
    steep = float(np.quantile(np.abs(near - far), 0.99)) / y_scale / STEP
    return max(0.0, math.log1p(size / max(1.0, observed / y_scale)) - math.log(3.0)) + max(0.0, math.log1p(steep) - math.log(1e5))


# Fixed values of the failure tags, and the share and least size of the worst slice.
NMSE_HIGH, P99_LEAST, BIAS, WORST_SHARE, WORST_LEAST, MOST_FEATURES = 0.05, 0.1, 0.05, 0.05, 4, 8


def failure_tags(nmse: Column, p99: Column, interaction: Column, nonlinear: Column, bias: Column) -> Column:
    """The failures that a state's metrics and the terms chosen for its residual show.

    interaction: a term joins the prediction with a feature; nonlinear: a term transforms the prediction; bias: mean residual over the scale of y.
    """
    rules = {
        "nmse_underfit": nmse > NMSE_HIGH, "tail_failure": p99 > F.greatest(F.lit(P99_LEAST), 2 * F.sqrt(F.greatest(nmse, F.lit(0.0)))),
        "missing_prediction_input_interaction": interaction, "missing_prediction_nonlinearity": nonlinear, "systematic_bias": F.abs(bias) > BIAS,
    }
    tags = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in rules.items()]))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("unexplained_signal")))


def failure_summary(df: DataFrame, keys: list[str], ident: str, y: Column, p: Column, xs: dict[str, Column], interaction: Column | None = None, nonlinear: Column | None = None) -> DataFrame:
    """By keys: what a prediction misses: tags, residual moments and the worst twentieth over the scale of y, and the features that the residual follows.

    The worst slice holds the largest errors, of equal ones the larger ids, at least four rows where there are as many.  Rows whose
    truth or prediction isn't finite are left out.
    """
    d = df.select(*keys, F.col(ident).alias("_id"), y.cast("double").alias("_y"), p.cast("double").alias("_p"), *[x.cast("double").alias(f"_x_{n}") for n, x in xs.items()], F.coalesce(interaction, F.lit(False)).alias("_i") if interaction is not None else F.lit(False).alias("_i"), F.coalesce(nonlinear, F.lit(False)).alias("_n") if nonlinear is not None else F.lit(False).alias("_n"))
    d = written(d.where(finite("_y") & finite("_p")).withColumn("_e", F.col("_y") - F.col("_p")).withColumn("_a", F.abs(F.col("_y") - F.col("_p"))), "failures")
    corr = [F.struct(-F.abs(safe_corr(F.col(f"_x_{n}"), F.col("_e"))).alias("size"), F.lit(n).alias("feature"), safe_corr(F.col(f"_x_{n}"), F.col("_e")).alias("correlation")) for n in xs]
    main = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_e").alias("_mean"), F.stddev_pop("_e").alias("_sd"), F.var_pop("_y").alias("_var"), F.avg(F.col("_e") * F.col("_e")).alias("_mse"), F.bool_or("_i").alias("_i"), F.bool_or("_n").alias("_n"), F.array_sort(F.array(*corr)).alias("_corr"))
    top = quantiles(d, F.abs("_y"), [0.95], keys).select(*keys, F.col("q").alias("_top"))
    rel = quantiles(d, F.col("_a") / F.greatest(F.abs("_y"), F.lit(1e-12)), [0.99], keys).select(*keys, F.col("q").alias("_p99"))
    sizes = main.select(*keys, F.least("n", F.greatest(F.lit(WORST_LEAST), F.ceil(F.lit(WORST_SHARE) * F.col("n")))).cast("long").alias("n_worst"), "n")
    worst = ranked(d, F.col("_a"), "_id", "_rank", keys).join(sizes, keys).where(F.col("_rank") >= F.col("n") - F.col("n_worst"))
    ends = worst.groupBy(*keys).agg(F.max("n_worst").alias("n_worst"), F.min("_y").alias("worst_y_low"), F.max("_y").alias("worst_y_high"), F.min("_p").alias("worst_p_low"), F.max("_p").alias("worst_p_high"))
    tail = quantiles(worst, F.col("_a"), [0.99], keys).select(*keys, F.col("q").alias("_tail"))
    scale = F.greatest(F.col("_top"), F.sqrt(F.greatest(F.col("_var"), F.lit(1e-15))), F.lit(1e-12))
    out = main
    for t in (top, rel, ends, tail):
        out = out.join(t, keys)
    out = out.withColumn("_s", scale).withColumn("nmse", F.col("_mse") / F.greatest(F.col("_var"), F.lit(1e-15)))
    followed = F.transform(F.slice("_corr", 1, MOST_FEATURES), lambda c: F.struct(c["feature"], c["correlation"]))
    return out.select(*keys, "n", "nmse", F.col("_p99").alias("p99"), failure_tags(F.col("nmse"), F.col("_p99"), F.col("_i"), F.col("_n"), F.col("_mean") / F.col("_s")).alias("tags"), (F.col("_mean") / F.col("_s")).alias("mean_scaled"), (F.col("_sd") / F.col("_s")).alias("sd_scaled"), "n_worst", "worst_y_low", "worst_y_high", "worst_p_low", "worst_p_high", (F.col("_tail") / F.col("_s")).alias("worst_p99_scaled"), followed.alias("follows"))
