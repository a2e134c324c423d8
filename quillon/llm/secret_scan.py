"""Secret scans with DataFrame functions only.

Base kinds are found by pattern.  Beyond them, two character Markov models, one of random
strings and one of ordinary identifiers, are trained from labelled samples by counting
pairs of characters; a long token whose log-likelihood ratio is over THRESHOLD and over
PER_CHAR a transition is a `random` span, if it touches no base span.

The labelled samples are made by rule (random strings from digests of integers, identifiers
from common words joined in the usual styles), or given as rows (token, secret).  The model
is a table of CLASSES squared log ratios, whatever the samples hold.

All of it is expressions over one row, so nothing is shuffled.  Defined cases: a null text is
empty; spans are code points, end exclusive; texts are scanned whole; repeated rows each
give a row, and rows of null ids too; an empty table gives no rows; spans that start together are ordered by kind,
of overlapping ones each is listed and `redact` masks their union; further columns are kept by `scan`, unless they have the
name of an output column or `_tokens`, and all are kept by `redact`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import documents

# The base patterns, and how long a match must be (of assign: its second group).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
HINT = r"(?i:passw|secret|token|api_?key)"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
THRESHOLD, PER_CHAR = 12.0, 0.35
MASK = "<secret>"

WORDS = "get set is has add remove update delete create find list map array string number index count value key name type id user account order item product price total date time start end first last next previous parent child node tree graph table column row field record file path dir read write open close load save parse format convert encode decode input output buffer stream socket client server request response header body status error message event handler listener callback promise async await cache pool queue stack heap thread process task worker job schedule config option setting default custom global local public private static final abstract class method function variable constant module package import export test mock assert expect validate check verify filter sort search match replace merge split join trim upper lower case length size width height color font style layout view model controller service manager factory builder provider context session token auth login logout register profile image video audio text button label menu page panel window dialog form".split()


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled tokens by rule: `secret` true for random strings, false for identifiers."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    wide = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(wide, "[+/]", "")), 1, 16))).when(F.col("id") % 4 == 2, wide).otherwise(F.regexp_replace(wide, "[+/]", "")).alias("token"),
        F.lit(True).alias("secret"),
    )
    words = F.array(*map(F.lit, WORDS))

    def word(k: int) -> Column:
        return F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))

    parts = [word(k) for k in range(4)]
    plain = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *parts)).when(F.col("id") % 4 == 1, F.concat(parts[0], *map(F.initcap, parts[1:]))).when(F.col("id") % 4 == 2, F.concat_ws("-", *parts[:3], (F.col("id") % 10).cast("string"))).otherwise(F.concat(*parts)).alias("token"),
        F.lit(False).alias("secret"),
    )
    return random.unionAll(plain)


def train(rows: DataFrame) -> list[float]:
    """Log ratio of random to ordinary for each pair of character classes; smoothed by half a count."""
    at = F.col("at")
    steps = rows.where(F.length("token") > 1).select("secret", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at"))
    code = [F.instr(F.lit(ALPHABET), F.substring(F.col("token"), at + k, F.lit(1))) for k in (0, 1)]
    counts = {(r[0], r[1], r[2]): r[3] for r in steps.groupBy("secret", code[0].alias("a"), code[1].alias("b")).count().collect()}
    total = {(s, a): sum(counts.get((s, a, b), 0) for b in range(CLASSES)) for s in (True, False) for a in range(CLASSES)}

    def p(s: bool, a: int, b: int) -> float:
        return (counts.get((s, a, b), 0) + 0.5) / (total[s, a] + 0.5 * CLASSES)

    return [round(math.log(p(True, a, b) / p(False, a, b)), 4) for a in range(CLASSES) for b in range(CLASSES)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, random over ordinary."""
    table = F.from_json(F.lit("[" + ",".join(map(str, model)) + "]"), "array<double>")

    def code(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(token, at, F.lit(1)))

    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda acc, i: acc + F.get(table, code(i) * CLASSES + code(i + 1)))


def found(text: Column, pattern: str, kind: int, least: int = 0) -> Column:
    """Spans (start, kind, end) of the matches, in order; least: of the second group."""
    between, match = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x) >= least) if least else None
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT>>)")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(between, i))
        end = start + F.length(F.get(match, i))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        more = F.concat(acc["spans"], one)
        return F.struct(end.alias("at"), (F.when(F.get(good, i), more).otherwise(acc["spans"]) if least else more).alias("spans"))

    walk = F.aggregate(F.sequence(F.lit(0), F.size(match) - 1), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(F.size(match) > 0, walk).otherwise(empty)


def spell(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The rows with `base_spans` and `spans`, both sorted by start, then kind."""
    model = model or train(samples(docs.sparkSession))
    text = F.coalesce("text", F.lit(""))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, kind: INT, end: INT>>)")

    def guarded(hint: str, spans: Column) -> Column:
        return F.when(text.rlike(hint), spans).otherwise(none)

    base = F.array_sort(F.concat(guarded(HINT, found(text, ASSIGN, 0, ASSIGN_LEAST)), guarded("AKIA", found(text, ACCESS, 1)), guarded("(?<![0-9a-f])[0-9a-f]{24}", found(text, HEX, 2))))
    rows = docs.drop("base_spans", "spans", "_tokens").withColumns({"base_spans": base, "_tokens": guarded(TOKEN, found(text, TOKEN, 3))})

    def random(x: Column) -> Column:
        token = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        score = ratio(token, model)
        apart = ~F.exists("base_spans", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
        return apart & token.rlike("[0-9]") & (score > THRESHOLD) & (score > PER_CHAR * (F.length(token) - 1))

    return rows.withColumn("spans", F.array_sort(F.concat("base_spans", F.filter("_tokens", random)))).drop("_tokens")


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The documents with each found span, or run of overlapping spans, replaced by MASK; n_chars follows.  Every other column stays as it is, whatever its name."""
    rows = scan(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")), model)
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.size("spans") > 0
    out = rows.withColumn("_new", F.when(hit, new).otherwise(text))
    own = lambda c: F.col("_row")[c]
    return out.select(*[F.col("_new").alias("text") if c == "text" else F.when(hit, F.length("_new").cast(docs.schema[c].dataType)).otherwise(own(c)).alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir).select("doc_id", "text"))

    def n(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")

    return rows.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(spell(F.col("base_spans")), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))


def brute(text: str | None) -> list[tuple[int, int, int]]:
    """Base spans by the contract's words, for tests."""
    import re

    out = []
    patterns = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            if len(m[2] if k == 0 else m[0]) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)
