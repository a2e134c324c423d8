"""Target-distribution importance resampling: documents drawn by how much likelier their words are under a target.

1. Counts.  Features are runs of up to LONGEST words; a feature's bucket is its CRC-32 modulo BUCKETS.
   Checksums are made in arrays: those of words byte by byte for all words at once, those of runs
   from their words' (a checksum is linear, so a word appended shifts it by tables).  Each
   task gives one array of counts; arrays are summed in a tree.
2. Weights.  The log ratio of smoothed bucket shares is an integer gain a bucket, BUCKETS in all,
   which go to the tasks; a document's weight is the floored mean of its features' gains.
   A Gumbel variate from the id's digest makes a draw without replacement of a cut by score.
3. Cut.  Scores are integers, so their histogram is exact.  Summed from the top it gives how
   many documents rank before each score and which score the draw ends in; only scores that are
   reached are ranked, by id within one score.  Gains lie within 1000 ln of a ratio of counts,
   so a histogram has at most some 200,000 rows whatever the input; it is broadcast.  Digests spread equal weights
   over scores: at most 0.04 % of the documents of one weight share one.

Defined cases: null and empty texts have no feature, weight 0, and are never drawn; texts of any
length are read whole; each of repeated rows is drawn by itself; rows without an id draw by the id 0;
ties of score go to the smaller id, ties of id to fewer features, then to the smaller weight; an
empty target has counts of zero; an empty table gives no rows; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.decontaminate import ACCEPT, FOLD
from quillon.llm.runtime import documents, input_bytes, short_batches, tidy, tree, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Input bytes for each group of the first level of the counts' sum.
MERGE_INPUT = 8 << 30
U32 = np.uint32
#: The polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320
#: Bytes of a word up to which its checksum is made together with others', and a shift is one look-up.
SHORT = 64


@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum of each byte from a zero register, and what n further zero bytes make of a register, for each of its bytes, n up to SHORT."""
    step = np.arange(256, dtype=U32)
    for _ in range(8):
        step = np.where(step & U32(1), (step >> U32(1)) ^ U32(POLYNOMIAL), step >> U32(1))
    shift = np.empty((SHORT + 1, 4, 256), U32)
    shift[0] = np.arange(256, dtype=U32) << (U32(8) * np.arange(4, dtype=U32)[:, None])
    for n in range(SHORT):
        shift[n + 1] = step[shift[n] & U32(255)] ^ (shift[n] >> U32(8))
    return step, shift


def word_crcs(w: tk.Words) -> np.ndarray:
    """CRC-32 of each word's folded bytes."""
    step, _ = crc_tables()
    fold = np.arange(256, dtype=np.uint8) if w.fold is None else w.fold.astype(np.uint8)
    size = w.end - w.start
    order = np.argsort(-size, kind="stable")
    size, start = size[order], w.start[order]
    n_long = int(np.searchsorted(-size, -SHORT))
    state = np.full(len(size), 0xFFFFFFFF, U32)
    for j in range(int(size[n_long]) if n_long < len(size) else 0):
        upto = int(np.searchsorted(-size, -j))
        on = state[n_long:upto]
        state[n_long:upto] = step[(on ^ fold[w.data[start[n_long:upto] + j]]) & U32(255)] ^ (on >> U32(8))
    state = ~state
    for k in range(n_long):
        state[k] = zlib.crc32(fold[w.data[start[k] : start[k] + size[k]]])
    out = np.empty(len(size), U32)
    out[order] = state
    return out


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of a checksum that stays when n bytes follow."""
    _, shift = crc_tables()
    crc, n = crc.copy(), n.copy()
    while len(far := np.flatnonzero(n > SHORT)):
        crc[far] = shifted(crc[far], np.full(len(far), SHORT))
        n[far] -= SHORT
    out = shift[n, 0, crc & U32(255)]
    for k in (1, 2, 3):
        out ^= shift[n, k, (crc >> U32(8 * k)) & U32(255)]
    return out


def buckets(w: tk.Words, longest: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `longest` words: the first word of each run that stays in its row, and its bucket."""
    word, length = word_crcs(w), w.end - w.start
    space = U32(zlib.crc32(b" "))
    run = word
    for k in range(1, longest + 1):
        if k > 1:
            m = max(0, len(word) - k + 1)
            run = shifted(shifted(run[:m], np.ones(m, np.int64)) ^ space, length[k - 1 :]) ^ word[k - 1 :]
        at = np.flatnonzero(tk.room(w, k))
        yield at, (run[at] % U32(size)).astype(np.int64)


def bucket_counts(docs: DataFrame, longest: int = LONGEST, size: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    @tidy("importance")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            data, bounds = tk.buffers(batch.column(0))
            for lo, hi in tk.slices(bounds):
                for _, b in buckets(tk.words(data, bounds, lo, hi, ACCEPT, FOLD), longest, size):
                    total += np.bincount(b, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    def merge(table: pa.Table) -> tuple:
        return (np.sum([np.frombuffer(x.as_py(), np.int64) for x in table.column("counts")], axis=0).tobytes(),)

    out = tree(short_batches(docs).select("text").mapInArrow(count, "part int, counts binary"), merge, input_bytes(docs) // MERGE_INPUT).collect()
    return np.frombuffer(out[0].counts, np.int64) if out else np.zeros(size, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of smoothed shares, floored; in doubles."""
    s_all, t_all = (float(x.sum()) + len(x) for x in (source, target))
    return np.array([math.floor(1000 * math.log(r)) for r in ((target + 1.0) * s_all / ((source + 1.0) * t_all)).tolist()], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """Per row: doc_id, words, features and weight of the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    @tidy("importance")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(bounds):
                w = tk.words(data, bounds, lo, hi, ACCEPT, FOLD)
                total, many = (np.zeros(len(w.start), np.int64) for _ in range(2))
                for at, b in buckets(w, longest, len(held.value)):
                    total[at] += held.value[b]
                    many[at] += 1
                total, many = (np.diff(np.concatenate(([0], np.cumsum(x)))[w.first]) for x in (total, many))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first), pa.int64()), pa.array(many, pa.int64()), pa.array(total // np.maximum(many, 1), pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, size: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight, score, and the rank of those drawn, `percent` of the documents of at least `least_words` words."""
    gain = gains(bucket_counts(docs, longest, size), bucket_counts(target, longest, size))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("doc_id", F.lit(0)).cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_words") >= least_words
    down = Window.orderBy(F.desc("score"))  # over the histogram, whose rows are bounded
    histogram = scored.where(able).groupBy("score").agg(F.count("*").alias("here"))
    reached = histogram.select("score", (F.sum("here").over(down) - F.col("here")).alias("above"), F.expr(f"{int(percent)} * sum(here) over () div 100").alias("drawn")).where("above < drawn")
    met = scored.join(F.broadcast(reached), "score", "left").withColumn("above", F.when(able, F.col("above")))
    nth = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight"))
    rank = F.col("above") + nth
    out = ("doc_id", "n_words", "n_features", "weight", "score")
    ranked = met.where("above is not null").select(*out, "drawn", rank.alias("rank")).select(*out, F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).alias("rank"))
    return ranked.unionByName(met.where("above is null").select(*out, F.lit(None).cast("long").alias("rank")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The contract in DuckDB's SQL.  A checksum is the exclusive or of what each byte makes of the register by the time the text ends.
SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS x FROM documents),
q AS MATERIALIZED (SELECT {_WORDS} AS x FROM benchmark),
fd AS MATERIALIZED (SELECT rid, unnest(x || list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS f FROM d),
fq AS MATERIALIZED (SELECT unnest(x || list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS f FROM q),
u AS MATERIALIZED (SELECT f, hex(f) AS hx, len(hex(f)) // 2 AS n FROM (SELECT f FROM fd UNION SELECT f FROM fq)),
bits(b, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END FROM bits WHERE k < 8),
step AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
far(n, b, c) AS (SELECT 1, b, c FROM step UNION ALL SELECT n + 1, far.b, xor(step.c, far.c >> 8) FROM far JOIN step ON step.b = far.c & 255 WHERE n < (SELECT max(n) FROM u)),
ones(n, c) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(step.c, ones.c >> 8) FROM ones JOIN step ON step.b = ones.c & 255 WHERE n < (SELECT max(n) FROM u)),
bytes AS (SELECT f, n, n - i AS left_over, CAST('0x' || hx[2 * i + 1:2 * i + 2] AS BIGINT) AS b FROM (SELECT f, hx, n, unnest(range(n)) AS i FROM u)),
crc AS MATERIALIZED (SELECT f, xor(xor(any_value(ones.c), bit_xor(far.c)), 4294967295) % {BUCKETS} AS bucket FROM bytes JOIN far ON far.n = left_over AND far.b = bytes.b JOIN ones ON ones.n = bytes.n GROUP BY f),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN crc USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fq JOIN crc USING (f) GROUP BY bucket),
g AS MATERIALIZED (SELECT r.range AS bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM fd) + {BUCKETS}) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM fq) + {BUCKETS})))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r LEFT JOIN s ON s.bucket = r.range LEFT JOIN t ON t.bucket = r.range),
w AS (SELECT rid, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM fd JOIN crc USING (f) JOIN g USING (bucket) GROUP BY rid),
z AS (SELECT doc_id, len(x) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || sha256('{SEED}:' || coalesce(doc_id, 0))[1:8] AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT doc_id, n_features, weight, score, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, doc_id, n_features, weight) AS k, words >= {LEAST_WORDS} AS able FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN able AND k <= {PERCENT} * (SELECT count(*) FROM r WHERE able) // 100 THEN k END AS rank FROM r
"""


def brute(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> list[tuple]:
    """The contract read literally, for tests."""

    def features(t: str | None) -> tuple[int, list[int]]:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return len(x), [zlib.crc32(f.encode()) % BUCKETS for f in x + [f"{a} {b}" for a, b in zip(x, x[1:], strict=False)]]

    s, t = [0] * BUCKETS, [0] * BUCKETS
    cut = [features(x) for _, x in docs]
    for count, texts in ((s, [f for _, f in cut]), (t, [features(x)[1] for x in target])):
        for f in texts:
            for b in f:
                count[b] += 1
    gain = [math.floor(1000 * math.log(float(t[b] + 1) * float(sum(s) + BUCKETS) / (float(s[b] + 1) * float(sum(t) + BUCKETS)))) for b in range(BUCKETS)]
    rows = []
    for (d, _), (words, f) in zip(docs, cut, strict=True):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{SEED}:{d or 0}".encode()).hexdigest()[:8], 16)
        rows.append((d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= LEAST_WORDS), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    kept = len(order) * PERCENT // 100
    out = [(d, n, w, sc, k + 1 if k < kept else None) for k, (d, _, n, w, sc) in enumerate(order)]
    return out + [(d, n, w, sc, None) for d, words, n, w, sc in rows if words < LEAST_WORDS]
