"""Ingest of numeric tables and their split into roles, with leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.columns import all_of, finite, numeric, seeded_hex
from quillon.operators.ordered import ranked, ranked_by_hex
from quillon.sources.shared import written
from quillon.sources.tables import finalise, read_delimited
from quillon.sources.workbooks import read_workbooks

DEVELOPMENT, VALIDATION, POOL, HELDOUT = "development", "validation", "acquisition-pool", "untouched-heldout"
ROLES = (DEVELOPMENT, VALIDATION, POOL, HELDOUT)
CUTS = (0.60, 0.75, 0.90)
LEAST_ROWS = 8


def numeric_frame(df: DataFrame, target: str, features: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Features and target as doubles; rows with a value that isn't finite are dropped."""
    features = features or [c for c in df.columns if c != target and c not in keep]
    df = df.select(*keep, *[numeric(c).alias(c) for c in [*features, target]])
    return df.where(all_of([finite(c) for c in [*features, target]]))


def row_ids(df: DataFrame, namespace: str, order: str) -> DataFrame:
    """Adds row_id, `namespace:000000` on, in the order of a numeric column."""
    return ranked(df, F.col(order), order, "_rank").withColumn("row_id", F.format_string("%s:%06d", F.lit(namespace), "_rank")).drop("_rank")


def role_of_rank(rank: Column, n: Column | int) -> Column:
    """Role by rank among n; boundaries round half to even."""
    n = F.lit(n) if isinstance(n, int) else n
    a, b, c = (F.rint(F.lit(x) * n) for x in CUTS)
    return F.when(rank < a, DEVELOPMENT).when(rank < b, VALIDATION).when(rank < c, POOL).otherwise(HELDOUT)


def hash_roles(df: DataFrame, ident: str, seed: int) -> DataFrame:
    """Adds a role by the order of SHA-256(seed:id), which no target can influence."""
    hexed = df.withColumn("_hex", seeded_hex(seed, F.col(ident).cast("string")))
    return ranked_by_hex(hexed, "_hex", "_rank").withColumn("role", role_of_rank(F.col("_rank"), df.count())).drop("_hex", "_rank")


def group_roles(group: Column, development: tuple[int, ...], validation: int, pool: int, heldout: int) -> Column:
    """Role by an integer group such as a year."""
    return F.when(group.isin(*development), DEVELOPMENT).when(group == validation, VALIDATION).when(group == pool, POOL).when(group == heldout, HELDOUT)


def budget_sample(df: DataFrame, ident: str, budget: int, seed: int) -> DataFrame:
    """The first `budget` rows by SHA-256(seed:id)."""
    return df.withColumn("_hex", seeded_hex(seed, F.col(ident).cast("string"))).orderBy("_hex").limit(budget).drop("_hex")


def selection_view(df: DataFrame, target: str) -> DataFrame:
    """What selection may see: no held-out rows, no targets of the pool."""
    return df.where(F.col("role") != HELDOUT).withColumn(target, F.when(F.col("role") == POOL, None).otherwise(F.col(target)))


def heldout(df: DataFrame) -> DataFrame:
    return df.where(F.col("role") == HELDOUT)


def acquire(df: DataFrame, chosen: DataFrame, ident: str) -> DataFrame:
    """The pool rows that were chosen, targets revealed."""
    return df.where(F.col("role") == POOL).join(chosen.select(ident), ident, "left_semi")


def row_fingerprint(columns: list[str]) -> Column:
    """SHA-256 of a row's values; null differs from any text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def shared_rows(df: DataFrame, columns: list[str], role: str = "role") -> DataFrame:
    """(role_a, role_b, n_shared): distinct rows that two roles share.  At most four roles meet in one group."""
    held = df.groupBy(row_fingerprint(columns).alias("row")).agg(F.array_sort(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1)
    pairs = held.select(F.explode("roles").alias("role_a"), "roles").select("role_a", F.explode("roles").alias("role_b")).where("role_a < role_b")
    return pairs.groupBy("role_a", "role_b").agg(F.count(F.lit(1)).alias("n_shared"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by `order`; copies collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def selection_scores(df: DataFrame, features: list[str], strategy: str, ident: str) -> DataFrame:
    """Adds `score`: the first feature, distance along the main axis, Mahalanobis distance, or distance from the median rank."""
    import numpy as np

    if strategy == "feature0":
        return df.withColumn("score", F.col(features[0]))
    if strategy == "critical_point":
        n = df.count()
        return ranked(df, F.col(features[0]), ident, "_rank").withColumn("score", F.abs(F.col("_rank") / F.lit(max(1, n - 1)) - 0.5)).drop("_rank")
    stats = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in features], *[F.covar_samp(a, b) for a in features for b in features]).first()
    d = len(features)
    mean, cov = np.array(stats[1 : 1 + d]), np.array(stats[1 + d :]).reshape(d, d)
    if strategy == "pca1":
        axis = np.linalg.eigh(cov)[1][:, -1]
        return df.withColumn("score", F.abs(sum(((F.col(c) - float(m)) * float(a) for c, m, a in zip(features, mean, axis, strict=True)), F.lit(0.0))))
    if strategy == "mahalanobis":
        inverse = np.linalg.pinv(cov + 1e-6 * np.eye(d))
        z = [F.col(c) - float(m) for c, m in zip(features, mean, strict=True)]
        return df.withColumn("score", F.sqrt(F.greatest(F.lit(0.0), sum((z[i] * z[j] * float(inverse[i, j]) for i in range(d) for j in range(d)), F.lit(0.0)))))
    raise ValueError(f"unknown strategy {strategy}")


def split(df: DataFrame, features: list[str], target: str, ident: str, train: float, pool: float, heldout_: float, strategy: str, seed: int) -> tuple[DataFrame, int]:
    """Rows with a role, and how many repeated rows were removed.

    Of rows that are equal in features and target the first by id stays.  The rows of highest selection
    score are the pool and the held-out ones, cut in seeded order; the others are development and validation.
    """
    if not (0 < train < 1 and pool >= 0 and heldout_ > 0 and pool + heldout_ < 0.8):
        raise ValueError("shares must lie in (0, 1), those of pool and held-out rows under 0.8 together")
    before = df.count()
    d = selection_scores(keep_first(df, [*features, target], [ident]), features, strategy, ident)
    n = d.count()
    if n < LEAST_ROWS:
        raise ValueError(f"{LEAST_ROWS} distinct rows are needed")
    extra = min(max(2, round(n * (pool + heldout_))), n - 4)
    n_pool = min(max(round(extra * pool / (pool + heldout_)), 0), extra - 1)
    n_train = min(max(2, round((n - extra) * train)), n - extra - 2)
    d = ranked(d, F.col("score"), ident, "_by_score").withColumn("_far", F.col("_by_score") >= n - extra)
    parts = []
    for far, cut, names in ((False, n_train, (DEVELOPMENT, VALIDATION)), (True, n_pool, (POOL, HELDOUT))):
        p = ranked_by_hex(d.where(F.col("_far") == far).withColumn("_hex", seeded_hex(seed, F.col(ident).cast("string"))), "_hex", "_rank")
        parts.append(p.withColumn("role", F.when(F.col("_rank") < cut, names[0]).otherwise(names[1])).drop("_hex", "_rank", "_far", "_by_score"))
    return parts[0].unionByName(parts[1]), before - n


def fingerprint(df: DataFrame, ident: str, columns: list[str], block: int = 4096, fan: int = 4096) -> str:
    """SHA-256 of the columns' values in the order of a unique integer id, of their number and names.

    Blocks of rows are digested side by side, then the blocks' digests (one a `block` ids), in a tree of that fan-out.
    """
    row = row_fingerprint(columns)
    each = df.groupBy(F.floor(F.col(ident) / block).alias("b")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(ident), row.alias("h")))), lambda x: x["h"]), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")
    blocks = each.agg(F.max("b")).first()[0] or 0
    while blocks >= fan:  # no row holds more than `fan` digests
        each = each.groupBy(F.floor(F.col("b") / fan).alias("b")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
        blocks //= fan
    whole = each.agg(joined.alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return whole.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.lit(",".join(columns)), "h"), 256)).first()[0]


def covariate_fingerprint(df: DataFrame, ident: str, features: list[str]) -> str:
    """The fingerprint of what may be seen: features without the target."""
    return fingerprint(df, ident, features)


def load(spark: SparkSession, path: str, target: str, features: list[str] | None = None, delimiter: str | None = None, header: bool = True, train: float = 0.7, pool: float = 0.15, held_out: float = 0.15, strategy: str = "pca1", seed: int = 42) -> tuple[DataFrame, dict]:
    """A delimited file or a workbook as rows with roles: scanned, coerced, cleaned, freed of repeated rows and split; and what was left out.

    features: all other columns where None, which must then be named in a header.  Columns of a headerless file are `_c0`, `_c1`, ....
    """
    if path.endswith(".xlsx"):
        if features is None:
            raise ValueError("the columns of a workbook must be named")
        raw = read_workbooks(spark, path, [*features, target]).select(*features, target)
    else:
        raw = read_delimited(spark, path, delimiter, header)
        features = features if features is not None else [c for c in raw.columns if c != target]
    clean = finalise(raw.select(*[c for c in raw.columns if c in (*features, target)]), features, target)
    # The id is the rank by values, so that it doesn't depend on how files are read.
    ident = ranked_by_hex(clean.withColumn("_hex", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in [*features, target]]), 256)), "_hex", "row_id").drop("_hex")
    before, held = raw.count(), written(ident, "loaded")
    out, repeated = split(held, features, target, "row_id", train, pool, held_out, strategy, seed)
    return out, {"scanned": before, "not_numeric": before - held.count(), "repeated": repeated}
