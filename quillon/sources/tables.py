"""Scans and sinks: delimited and white-space files, JSON lines, registered datasets, digests and tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.columns import all_of, finite, numeric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """CSV, or TSV by its suffix; all columns are text, since numbers are coerced later.  Other suffixes raise."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".csv", ".tsv", ".txt"):
        raise ValueError(f"unsupported file type {suffix}")
    return spark.read.csv(path, sep=delimiter or ("\t" if suffix == ".tsv" else ","), header=header, inferSchema=False)


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A headerless file of white-space separated numbers."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[numeric(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)])


def union_years(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """UNION ALL of yearly files, in year order, with the year as `group`."""
    out = None
    for year in sorted(paths):
        part = read_delimited(spark, paths[year]).withColumn("group", F.lit(year))
        out = part if out is None else out.unionByName(part)
    return out


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines.  strict: a blank or broken line raises; else such lines are left out."""
    if strict:
        if not spark.read.text(path).where(F.trim("value") == "").isEmpty():
            raise ValueError("blank line in a strict log")
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def file_digests(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, root: str) -> str:
    """One digest over sorted (relative path, file digest)."""
    rel = F.substring_index("path", root.rstrip("/") + "/", -1)
    rows = file_digests(spark, root).select(rel.alias("path"), "sha256").orderBy("path")
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws("\0", x["path"], x["sha256"])), "\n"), 256)).first()[0]


def find_unique(spark: SparkSession, root: str, filename: str, tokens: list[str]) -> str:
    """The one file of that name with a token in a parent's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", filename).load(root).select("path").collect()
    good = [r.path for r in found if any(t in Path(r.path).parent.as_posix() for t in tokens)]
    if len(good) != 1:
        raise ValueError(f"{len(good)} files match {filename}")
    return good[0]


def allowed_path(path: str, root: str, forbidden: tuple[str, ...] = ()) -> None:
    """Raise where a path leaves the root or has a forbidden part."""
    p, r = Path(path).resolve(), Path(root).resolve()
    if not p.is_relative_to(r) or set(p.relative_to(r).parts) & set(forbidden):
        raise ValueError(f"{path} isn't allowed")


def verified(df: DataFrame, expected: str | None, actual: str) -> DataFrame:
    if expected is not None and expected != actual:
        raise ValueError("the digest differs")
    return df


def finalise(df: DataFrame, features: list[str], target: str, expected_rows: int | None = None) -> DataFrame:
    """Required columns as doubles, finite rows only, and an exact row count if one is given."""
    if missing := [c for c in [*features, target] if c not in df.columns]:
        raise ValueError(f"missing columns {missing}")
    keep = [c for c in df.columns if c not in (*features, target)]
    out = df.select(*keep, *[numeric(c).alias(c) for c in [*features, target]]).where(all_of([finite(c) for c in [*features, target]]))
    if expected_rows is not None and (n := out.count()) != expected_rows:
        raise ValueError(f"{n} rows instead of {expected_rows}")
    return out


class Registry:
    """Datasets by id; ids are trimmed and lower-cased, unknown ones raise."""

    def __init__(self) -> None:
        self._made: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

    def add(self, name: str, make: Callable[[SparkSession, str], DataFrame]) -> None:
        self._made[name.strip().lower()] = make

    def ids(self) -> tuple[str, ...]:
        return tuple(sorted(self._made))

    def load(self, spark: SparkSession, name: str, root: str) -> DataFrame:
        key = name.strip().lower()
        if key not in self._made:
            raise ValueError(f"unknown dataset {name}")
        return self._made[key](spark, root)


def write_csv(df: DataFrame, path: str) -> None:
    """A table with sorted columns; an empty one raises."""
    if df.isEmpty():
        raise ValueError("an empty table isn't written")
    df.select(sorted(df.columns)).write.mode("overwrite").csv(path, header=True)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't among the new ones, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
