"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Exact copies collapse to the text of least id by a digest of the text.
2. Document frequencies of SHINGLE-word shingles are counted over all documents, in DF_CELLS hashed
   counters (a bound on what is broadcast; shared counters overestimate).  A shingle weighs
   (1 + ln tf) * (1 + ln((N + 1) / (df + 1))).
3. Improved consistent weighted sampling draws SAMPLES samples a text: two texts agree in one with
   the probability of their weighted Jaccard similarity.  The same random numbers give SAMPLES
   samples under unit weights.  Two texts are linked if they share THRESHOLD or more by TF-IDF
   weights, or by unit weights: a large group of copies makes its own shingles frequent, and by
   TF-IDF alone the few edited words of a copy would then outweigh all that is shared.
4. Either kind of samples makes BANDS bands of ROWS samples; texts that agree in a band meet in a
   bucket.  A pair of similarity 0.8 by one of the measures misses all its bands with probability
   (1 - 0.8**3)**12 = 2e-4.  A pair is looked at in the first band that it agrees in only.
5. Signatures of a bucket are compared in array kernels, which emit candidates only: first, a few
   times, for each text its most similar text of another class (at most one a text and bucket),
   until most copies are joined; then every pair of different classes whose LONG weighted samples,
   or least hashes of UNIT_BINS bins of shingles, agree as only one pair of 0.8 in 2,000 would fail
   to.  So each two texts that meet share a class or were verified, whatever their bucket holds;
   joined texts stay in their buckets.  Pairs of one class are skipped: of a bucket only texts
   outside its largest class are compared with all.
6. Candidates are verified on the whole texts; links join classes by least label with pointer
   jumping: in one task for up to FEW_LINKS links, beyond that in tables of the shared folder.
   What comes to the driver has a fixed size.

A bucket of more than BLOCK texts is dealt as pairs of blocks, so no task holds more than two.
What stays quadratic is the comparison of signatures, inside kernels, between texts of a bucket
that are in different classes.

Defined cases: null texts and texts without a word are alone in their class; a text of fewer than
SHINGLE words is one shingle; rows of one id share its class, whatever their texts; rows without an
id share the class null; ties go to the smaller id; an empty table gives no rows; texts of any length
are read whole; further columns, whatever their names, are ignored by `classes` and kept by `clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.runtime import Scratch, documents, input_bytes, short_batches, tidy, tree
from quillon.llm.substring_dedup import ACCEPT

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
DF_BITS, DF_PARTS = 20, 64
#: Weighted samples, and bins of unit weights, of texts whose buckets hold several classes after the first rounds.
LONG, UNIT_BINS = 192, 512
#: Rounds that look at each text's most similar one before all pairs are looked at.
NEAREST_ROUNDS = 2
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 3.3
#: Texts of one bucket that a task holds, twice.
BLOCK = 2048
#: Groups up to this size are compared together, by distance in the group.
SMALL = 48
#: Rows that a task of the kernel gets, on average.
KERNEL_ROWS = 1 << 12
#: Bits of the filter that keeps other documents' texts from the shuffle: 4 MB.
FILTER_BITS, FILTER_PARTS = 1 << 25, 64
BITS = 48
#: Links that one task may join: 16 MB.
FEW_LINKS = 1 << 20
#: Input bytes for each file of a table of links.
FILE_INPUT = 64 << 20
#: Input bytes for each group of the first level of a merge.
MERGE_INPUT = 1 << 30
QUANTILES = 1 << 16


def shingles(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of rows lo to hi: 48-bit ids, counts, and where each row starts."""
    w = tk.words(data, bounds, lo, hi, ACCEPT)
    n = np.diff(w.first)
    rows = w.row
    g = tk.grams(w, SHINGLE)
    whole = np.flatnonzero(tk.room(w, SHINGLE))
    ids, of = g[whole], rows[whole]
    for size in range(1, SHINGLE):
        if (short := w.first[:-1][n == size]).size:
            ids = np.concatenate((ids, tk.grams(w, size)[short]))
            of = np.concatenate((of, rows[short]))
    key = (of.astype(np.uint64) << tk.U64(BITS)) | (ids >> tk.U64(64 - BITS))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    start = np.searchsorted(key >> tk.U64(BITS), np.arange(hi - lo + 1, dtype=np.uint64))
    return key & tk.U64((1 << BITS) - 1), count, start


def row_slices(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of the buffer that fit the row number into the bits above a shingle."""
    most = (1 << (64 - BITS)) - 1
    for lo, hi in tk.slices(bounds):
        for k in range(lo, hi, most):
            yield k, min(hi, k + most)


def cell(ids: np.ndarray) -> np.ndarray:
    return (tk.mix(ids) >> tk.U64(64 - DF_BITS)).astype(np.int64)


def frequencies(docs: DataFrame, groups: int) -> tuple[np.ndarray, int]:
    """Hashed document frequencies over all documents, and their number.  groups: of the merge's first level."""
    each = (1 << DF_BITS) // DF_PARTS

    @tidy("near_dedup")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << DF_BITS, np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            data, bounds = tk.buffers(batch.column(0))
            for lo, hi in row_slices(bounds):
                ids, _, _ = shingles(data, bounds, lo, hi)
                total += np.bincount(cell(ids), minlength=len(total))
        if n:
            parts = total.reshape(DF_PARTS, each)
            yield pa.RecordBatch.from_arrays([pa.array(range(DF_PARTS), pa.int32()), pa.array([tk.planes(p) for p in parts], pa.binary()), pa.array([n] * DF_PARTS, pa.int64())], names=["part", "counts", "n"])

    def merge(table: pa.Table) -> tuple:
        total = np.zeros(each, np.int64)
        for x in table.column("counts"):
            total += tk.unplanes(x.as_py(), np.int64)
        return tk.planes(total), sum(table.column("n").to_pylist())

    out, n = np.zeros((DF_PARTS, each), np.int64), 0
    for part, counts, n in tree(docs.select("text").mapInArrow(count, "part int, counts binary, n long"), merge, groups).collect():
        out[part] = tk.unplanes(counts, np.int64)
    return out.reshape(-1), n


def log_idf(df: np.ndarray, n: int) -> np.ndarray:
    """Logarithm of each counter's idf."""
    return np.log(1 + np.log((n + 1) / (np.minimum(df, n) + 1))).astype(np.float32)


@lru_cache(maxsize=1)
def variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2,1) at QUANTILES even quantiles (r, 1/r, ln c), and a uniform (b)."""
    u = (np.arange(QUANTILES) + 0.5) / QUANTILES
    lo, hi = np.zeros(QUANTILES), np.full(QUANTILES, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    r = (lo + hi) / 2
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(r).astype(np.float32), u.astype(np.float32)


def sample(ids: np.ndarray, log_weight: np.ndarray, start: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """That many 32-bit samples of each row (rows x samples) by weight, and by unit weights; rows without shingles get zeros."""
    r_of, inv_of, c_of, b_of = variates()
    full = np.flatnonzero(start[1:] > start[:-1])
    out, unit = (np.zeros((len(start) - 1, samples), np.uint32) for _ in range(2))
    if not len(full):
        return out, unit
    at, low = start[full], tk.U64(0xFFFF)
    for k in range(samples):
        x = (ids ^ tk.U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * tk.U64(0xD6E8FEB86659FD93)
        x ^= x >> tk.U64(29)
        x *= tk.U64(0xBF58476D1CE4E5B9)
        x ^= x >> tk.U64(32)
        r = (x & low).astype(np.int32)
        b = b_of[((x >> tk.U64(32)) & low).astype(np.int32)]
        t = np.floor(log_weight * inv_of[r] + b)
        y = c_of[((x >> tk.U64(16)) & low).astype(np.int32)] - r_of[r] * (t - b + np.float32(1))
        rank = (y + np.float32(128)).view(np.uint32).astype(np.uint64) << tk.U64(32)
        name = (x * tk.U64(0x94D049BB133111EB) + t.astype(np.int64).view(np.uint64) * tk.U64(0x9E3779B97F4A7C15)) >> tk.U64(32)
        out[full, k] = np.minimum.reduceat(rank | name, at).astype(np.uint32)
        unit[full, k] = np.minimum.reduceat(x, at).astype(np.uint32)
    return out, unit


def bins(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of each row (rows x UNIT_BINS): a byte of the least hash of the shingles in each bin, 0 where there is none."""
    x = tk.mix(ids ^ tk.U64(0xA24BAED4963EE407))
    out = np.full((len(start) - 1) * UNIT_BINS, ~tk.U64(0))
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    np.minimum.at(out, row * UNIT_BINS + (x % tk.U64(UNIT_BINS)).astype(np.int64), x // tk.U64(UNIT_BINS))
    return np.where(out == ~tk.U64(0), 0, out % tk.U64(255) + tk.U64(1)).astype(np.uint8).reshape(-1, UNIT_BINS)


def bytes_of(weighted: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Signatures of one byte a sample; those by unit weights aren't 0."""
    return np.concatenate((weighted.astype(np.uint8), (unit % 255 + 1).astype(np.uint8)), axis=1)


def weights(ids: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.log1p(np.log(count)).astype(np.float32) + idf[cell(ids)]


def band_keys(sig: np.ndarray, first: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; first: the number of the first band."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.arange(first + 1, first + BANDS + 1, dtype=np.uint64)[None, :] * tk.U64(0xA0761D6478BD642F)
    for k in range(ROWS):
        key = tk.mix(key ^ parts[:, :, k])
    return key


def blobs(x: np.ndarray) -> pa.Array:
    """A binary value of each row."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def signatures(docs: DataFrame, idf) -> DataFrame:
    """Per row: digest of the text, one byte a sample, and a key a band (whole in `bands`, 32 bits in `keys`); idf: a broadcast of log_idf()."""

    @tidy("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in row_slices(bounds):
                ids, count, start = shingles(data, bounds, lo, hi)
                both = sample(ids, weights(ids, count, idf.value), start)
                key = np.concatenate([band_keys(s, k * BANDS) for k, s in enumerate(both)], axis=1)
                some = start[1:] > start[:-1]
                ends = np.concatenate(([0], np.cumsum(some * key.shape[1]))).astype(np.int32)
                digest = [blake2b(data[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() for i in range(lo, hi)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(digest, pa.binary()), blobs(bytes_of(*both)), pa.ListArray.from_arrays(pa.array(ends), pa.array(key[some].view(np.int64).reshape(-1))), blobs(key.astype(np.uint32))],
                    names=["doc_id", "digest", "sig", "bands", "keys"],
                )

    return docs.mapInArrow(run, "doc_id long, digest binary, sig binary, bands array<long>, keys binary")


def long_signatures(texts: DataFrame, idf) -> DataFrame:
    """(doc, sig): LONG weighted samples and the bins, for the texts whose buckets hold several classes."""

    @tidy("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in row_slices(bounds):
                ids, count, start = shingles(data, bounds, lo, hi)
                weighted, _ = sample(ids, weights(ids, count, idf.value), start, LONG)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), blobs(np.concatenate((weighted.astype(np.uint8), bins(ids, start)), axis=1))], names=["doc", "sig"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc long, sig binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of sorted ids with weights."""
    total = float(a[1].sum() + b[1].sum())
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    both = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return both / (total - both) if total else 0.0


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two texts (ids, weights) are linked."""
    both = len(np.intersect1d(a[0], b[0], assume_unique=True))
    return both >= THRESHOLD * (len(a[0]) + len(b[0]) - both) > 0 or similarity(a, b) >= THRESHOLD


def verified(links: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The links (doc, lead) whose whole texts are alike."""

    @tidy("near_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [tk.buffers(batch.column(k)) for k in (2, 3)]
            good: list[bool] = []
            for lo, hi in row_slices(sides[0][1] + sides[1][1]):
                vectors = []
                for data, bounds in sides:
                    ids, count, start = shingles(data, bounds, lo, hi)
                    w = np.exp(weights(ids, count, idf.value)).astype(np.float64)
                    vectors.append([(ids[a:b], w[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)])
                good += [alike(a, b) for a, b in zip(*vectors, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["doc", "lead", "similar"])

    both = links.join(texts.select(F.col("doc_id").alias("doc"), F.col("text").alias("a")), "doc").join(texts.select(F.col("doc_id").alias("lead"), F.col("text").alias("b")), "lead")
    return both.select("doc", "lead", "a", "b").mapInArrow(run, "doc long, lead long, similar boolean").where("similar").select("doc", "lead")


class Pairs:
    """Comparison of the signatures of one task's groups.  Rows are sorted by group; a group is a bucket or two blocks of one.

    sig: `weighted` bytes that agree in the share of the weighted similarity, then bytes by unit weights,
    of which 0 is none.
    """

    def __init__(self, sig: np.ndarray, weighted: int, keys: np.ndarray, label: np.ndarray, group: np.ndarray, nth: np.ndarray, side: np.ndarray, two: np.ndarray, nearest: bool):
        self.weighted, self.unit, self.keys, self.label, self.nth, self.side, self.two, self.nearest = sig[:, :weighted], sig[:, weighted:], keys, label, nth, side, two, nearest
        self.least = [THRESHOLD - SLACK * math.sqrt(THRESHOLD * (1 - THRESHOLD) / x.shape[1]) for x in (self.weighted, self.unit)]
        self.best, self.mate = np.zeros(len(label), np.float32), np.full(len(label), -1)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        end = np.append(cut[1:], len(group))
        self.small(np.repeat(np.where(end - cut <= SMALL, end, cut), end - cut))
        for a, b in zip(cut[end - cut > SMALL], end[end - cut > SMALL], strict=True):
            self.large(int(a), int(b))

    def score(self, weighted: np.ndarray, unit: np.ndarray, none: np.ndarray) -> np.ndarray:
        """The larger estimate of a pair, 0 if neither reaches its least value.  none: bytes that both lack."""
        w = weighted / np.float32(self.weighted.shape[1])
        u = (unit - none) / np.maximum(self.unit.shape[1] - none, 1).astype(np.float32)
        return np.where((w >= self.least[0]) | (u >= self.least[1]), np.maximum(w, u), 0).astype(np.float32)

    def note(self, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        """Candidates i, j; where only the nearest are wanted each i and each j comes once in a call."""
        if not self.nearest:
            self.found.append((i, j))
            return
        for x, y in ((i, j), (j, i)):
            better = score > self.best[x]
            self.best[x[better]], self.mate[x[better]] = score[better], y[better]

    def small(self, end: np.ndarray) -> None:
        at = np.arange(len(end))
        for d in range(1, SMALL):
            i = np.flatnonzero(end - at > d)
            if not len(i):
                return
            j = i + d
            keep = (self.label[i] != self.label[j]) & ((self.side[i] != self.side[j]) | ~self.two[i])
            i, j = i[keep], j[keep]
            before = np.arange(self.keys.shape[1])[None, :] < self.nth[i][:, None]
            keep = ~((self.keys[i] == self.keys[j]) & before).any(axis=1)
            i, j = i[keep], j[keep]
            a, b = self.unit[i], self.unit[j]
            score = self.score((self.weighted[i] == self.weighted[j]).sum(axis=1), (a == b).sum(axis=1), ((a | b) == 0).sum(axis=1))
            keep = score > 0
            self.note(i[keep], j[keep], score[keep])

    def large(self, a: int, b: int) -> None:
        rows = np.arange(a, b)
        if self.two[a]:
            left, right = rows[~self.side[a:b]], rows[self.side[a:b]]
            if not len(right):
                return
        else:
            names, size = np.unique(self.label[a:b], return_counts=True)
            left, right = rows[self.label[a:b] != names[size.argmax()]], rows
        band, other = int(self.nth[a]), self.label[right]
        columns = [np.ascontiguousarray(x[right].T) for x in (self.weighted, self.unit)]
        lacking = (columns[1] == 0).astype(np.float32)
        known = np.ascontiguousarray(self.keys[right, :band].T)
        outer = np.zeros(len(self.label), bool)
        outer[left] = True
        for k in range(0, len(left), 256):
            i = left[k : k + 256]
            agree = np.zeros((2, len(i), len(right)), np.int16)
            for sig, column, total in zip((self.weighted, self.unit), columns, agree, strict=True):
                for s in range(sig.shape[1]):
                    total += sig[i, s][:, None] == column[s][None, :]
            score = self.score(agree[0], agree[1], (self.unit[i] == 0).astype(np.float32) @ lacking)
            good = (score > 0) & (self.label[i][:, None] != other[None, :])
            if not self.two[a]:  # a pair of two outer texts is seen from both
                good &= ~outer[right][None, :] | (i[:, None] < right[None, :])
            for s in range(band):
                good &= self.keys[i, s][:, None] != known[s][None, :]
            if not self.nearest:
                x, y = np.nonzero(good)
                self.found.append((i[x], right[y]))
                continue
            score = np.where(good, score, 0)
            for mine, theirs, values in ((i, right, score), (right, i, score.T)):
                at = values.argmax(axis=1)
                top = values[np.arange(len(mine)), at]
                better = top > self.best[mine]
                self.best[mine[better]], self.mate[mine[better]] = top[better], theirs[at[better]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if self.nearest:
            at = np.flatnonzero(self.mate >= 0)
            return at, self.mate[at]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*self.found, strict=True)) or ([], [])))


def candidates(buckets: DataFrame, signed: DataFrame, weighted: int, nearest: bool, scratch: Scratch) -> DataFrame:
    """Distinct pairs (doc, lead) of different classes that may be alike.  buckets: bucket, nth, doc, label and blocks; signed: doc, sig (its first `weighted` bytes by weight) and keys."""
    dealt = buckets.select("bucket", "nth", "doc", "label", F.pmod(F.xxhash64("doc"), "blocks").cast("int").alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", "nth", "doc", "label", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    parts = max(buckets.sparkSession.sparkContext.defaultParallelism, (buckets.agg(F.sum("blocks")).first()[0] or 0) // KERNEL_ROWS + 1)
    rows = dealt.join(signed, "doc").withColumn("part", F.pmod(F.xxhash64("bucket", "lo", "hi"), F.lit(parts)).cast("int"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c = {n: table.column(n).to_numpy() for n in ("bucket", "lo", "hi", "side", "doc", "label", "nth")}
        order = np.lexsort((c["doc"], c["side"], c["hi"], c["lo"], c["bucket"]))
        c = {n: x[order] for n, x in c.items()}
        same = np.logical_and.reduce([c[n][1:] == c[n][:-1] for n in ("bucket", "lo", "hi")])
        group = np.concatenate(([0], np.cumsum(~same)))
        sig, keys = (tk.buffers(table.column(n))[0].reshape(len(order), -1)[order] for n in ("sig", "keys"))
        x, y = (c["doc"][k] for k in Pairs(sig, weighted, keys.view(np.uint32), c["label"], group, c["nth"], c["side"] != c["lo"], c["lo"] != c["hi"], nearest).pairs())
        return pa.table({"doc": pa.array(np.maximum(x, y)), "lead": pa.array(np.minimum(x, y))})

    return scratch.written(rows.groupBy("part").applyInArrow(compare, "doc long, lead long").distinct(), "candidates")


def id_filter(ids: DataFrame, groups: int):
    """A predicate on doc_id that holds for all the ids and few others, from FILTER_BITS bits whatever the ids' number."""
    each = FILTER_BITS // 8 // FILTER_PARTS

    def place(x: np.ndarray) -> np.ndarray:
        return (tk.mix(x.astype(np.int64).view(np.uint64)) >> tk.U64(64 - (FILTER_BITS - 1).bit_length())).astype(np.int64)

    @tidy("near_dedup")
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(place(batch.column(0).to_numpy()))
            part = at // (each * 8)
            for p in np.unique(part):
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([(at[part == p] - p * each * 8).astype(np.int32).tobytes()], pa.binary())], names=["part", "at"])

    def unite(table: pa.Table) -> tuple:
        bits = np.zeros(each * 8, bool)
        for x in table.column("at"):
            bits[np.frombuffer(x.as_py(), np.int32)] = True
        return (np.flatnonzero(bits).astype(np.int32).tobytes(),)

    held = np.zeros((FILTER_PARTS, each * 8), bool)
    for part, at in tree(ids.select("doc_id").mapInArrow(mark, "part int, at binary"), unite, groups).collect():
        held[part, np.frombuffer(at, np.int32)] = True
    sent = ids.sparkSession.sparkContext.broadcast(np.packbits(held.reshape(-1)))

    @F.pandas_udf("boolean")
    def maybe(x: pd.Series) -> pd.Series:
        at = place(x.to_numpy())
        return pd.Series((sent.value[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0)

    return maybe


def texts_of(docs: DataFrame, ids: DataFrame, groups: int) -> DataFrame:
    """The documents of these ids.  A filter of bounded size drops most others before the shuffle."""
    return docs.where(id_filter(ids, groups)("doc_id")).join(ids, "doc_id", "left_semi")


def mixed(buckets: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (bucket, nth, doc) with label, of the buckets that hold two classes or more, and in how many blocks a bucket is dealt."""
    now = buckets.join(labels, "doc", "left").select("bucket", "nth", "doc", F.coalesce("label", "doc").alias("label"))
    held = now.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("least <> most").select("bucket", "blocks")
    return scratch.written(now.join(held, "bucket"), "buckets")


def linked(reps: DataFrame, docs: DataFrame, idf, groups: int, scratch: Scratch) -> DataFrame:
    """(doc, label) of the texts that have a link: the least id that they are connected to.  reps: doc_id, sig, bands and keys."""
    spark = docs.sparkSession
    labels = scratch.written(spark.createDataFrame([], "doc long, label long"), "labels")
    buckets = mixed(reps.select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("nth", "bucket")), labels, scratch)
    ids = scratch.written(buckets.select(F.col("doc").alias("doc_id")).distinct(), "ids")
    signed = scratch.written(reps.join(ids, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "sig", "keys"), "signed", few=False)
    texts = scratch.written(texts_of(docs, ids, groups), "texts", few=False)
    for k in range(NEAREST_ROUNDS + 1):
        if buckets.isEmpty():
            break
        nearest = k < NEAREST_ROUNDS
        if not nearest:
            rest = scratch.written(buckets.select(F.col("doc").alias("doc_id")).distinct(), "rest")
            long = long_signatures(texts.join(rest, "doc_id", "left_semi"), idf).dropDuplicates(["doc"])
            signed = scratch.written(long.join(signed.select("doc", "keys"), "doc"), "long", few=False)
        links = scratch.written(verified(candidates(buckets, signed, SAMPLES if nearest else LONG, nearest, scratch), texts, idf), "links")
        if not links.isEmpty():
            labels = components(links.unionByName(labels.where("doc <> label").select("doc", F.col("label").alias("lead"))), scratch)
            buckets = mixed(buckets.select("bucket", "nth", "doc"), labels, scratch) if nearest else buckets
    return labels


def joined_here(key: tuple, table: pa.Table) -> pa.Table:
    """components() of one table."""
    ids, ends = np.unique(np.concatenate([table.column(k).to_numpy() for k in ("doc", "lead")]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == label).all():
            return pa.table({"doc": pa.array(ids), "label": pa.array(ids[label])})
        label = new


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, label) of every end of an edge: the least id that it is connected to."""
    edges = scratch.written(edges.select("doc", "lead"), "joined")
    if edges.count() <= FEW_LINKS:
        return scratch.written(edges.groupBy(F.lit(0).alias("all")).applyInArrow(joined_here, "doc long, label long"), "labels")
    both = scratch.written(edges.select(F.col("doc").alias("x"), F.col("lead").alias("y")).unionAll(edges.select(F.col("lead").alias("x"), F.col("doc").alias("y"))).distinct(), "edges")
    labels = scratch.written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")), "labels")
    while True:
        via = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = scratch.written(labels.join(via, "x").select("x", F.least("label", "near").alias("new"), F.col("label").alias("old")), "step")
        if step.where("new <> old").isEmpty():
            return labels.select(F.col("x").alias("doc"), "label")
        jump = step.select("x", "new").join(step.select(F.col("x").alias("new"), F.col("new").alias("next")), "new", "left")
        labels = scratch.written(jump.select("x", F.least("new", F.coalesce("next", "new")).alias("label")), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id and class_id, the least id of its class.  The work is done in the call; its result is a table."""
    docs = short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spark, size = docs.sparkSession, input_bytes(docs)
    groups = -(-size // MERGE_INPUT)
    df, n = frequencies(docs, groups)
    idf = spark.sparkContext.broadcast(log_idf(df, n))
    with Scratch(spark, max(2 * spark.sparkContext.defaultParallelism, size // FILE_INPUT)) as scratch:
        sigs = scratch.written(signatures(docs, idf), "signatures", few=False)
        worded = sigs.where((F.size("bands") > 0) & F.col("doc_id").isNotNull())
        least = scratch.written(worded.groupBy("digest").agg(F.min("doc_id").alias("rep")), "least")
        members = scratch.written(worded.select("doc_id", "digest").distinct().join(least, "digest").select("doc_id", "rep").distinct(), "members")
        reps = scratch.written(worded.join(least, (worded["doc_id"] == least["rep"]) & (worded["digest"] == least["digest"]), "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "sig", "bands", "keys"), "reps", few=False)
        label = linked(reps, docs, idf, groups, scratch)
        several = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
        if not several.isEmpty():  # rows of one id with several texts, which it links
            more = members.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), F.col("rep").alias("lead"))
            label = components(label.where("doc <> label").select("doc", F.col("label").alias("lead")).unionByName(more), scratch)
        of = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
        ids = sigs.select("doc_id").distinct().join(of, "doc_id", "left")
        return scratch.written(ids.join(label, ids["rep"] == label["doc"], "left").select("doc_id", F.coalesce("label", "rep", "doc_id").alias("class_id")), "classes", keep=True)


def clean(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of least id, with all columns; rows of that id that repeat it stay, rows without an id too."""
    gone = classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def brute(texts: list[str | None]) -> list[int]:
    """The class of each text by comparing all with all, for tests: texts are linked by TF-IDF or unit weights; equal texts count once."""
    data, bounds = tk.buffers(pa.array([t or "" for t in texts], pa.string()))
    ids, count, start = shingles(data, bounds, 0, len(texts))
    df = np.bincount(cell(ids), minlength=1 << DF_BITS)
    w = np.exp(weights(ids, count, log_idf(df, len(texts)))).astype(np.float64)
    vectors = [(ids[a:b], w[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    holders: dict[int, list[int]] = {}
    parent = list(range(len(texts)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, v in enumerate(vectors):
        met = {j for i in v[0].tolist() for j in holders.get(i, ())}
        for j in met:
            if root(j) != root(k) and alike(v, vectors[j]):
                a, b = sorted((root(j), root(k)))
                parent[b] = a
        for i in v[0].tolist():
            holders.setdefault(i, []).append(k)
    return [root(k) for k in range(len(texts))]
