"""Benchmark decontamination by winnowing.

Words of both sides are hashed.  Of the hashes of GRAM consecutive words, the least of each
run of WINDOW - GRAM + 1 is a fingerprint, so any WINDOW words shared by a text and an item
share one.  Text fingerprints are looked up among the items' fingerprints; a hit is extended
to the whole windows around it, which are compared by a second hash and then byte by byte.
Items shorter than a window are looked up as whole n-grams of their own length.

A benchmark of at most BLOCK_BYTES bytes, which is checked, is sent to the executors, and the join
takes place where the texts are read.  A larger one stays a table: a filter of FILTER_BITS bits
of its fingerprints goes to the texts, whose windows that pass are joined with the items'
windows by hash and bytes.  Only windows that the filter lets pass are shuffled, each once a text;
rows of equal id and text are joined once and given back as often as they came.

Defined cases: a null or empty text has no words and no hits; a null or empty item has no
window; repeated documents each give a row, rows without an id too; repeated items and items of
one id count once; an empty table on either side gives no hits; texts of any length are read
whole; further columns of the input, whatever their names, are ignored by `hits` and kept by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.runtime import input_bytes, short_batches, tidy, tree, written

WINDOW, GRAM = 10, 5
#: Most bytes of benchmark text that are broadcast: its tables take some 150 to 200 times as much, and two seconds a megabyte to make.
BLOCK_BYTES = 1 << 20
#: Bits of the filter that a larger benchmark's fingerprints are kept in (32 MB), and its parts.
FILTER_BITS, FILTER_PARTS = 1 << 28, 256
MERGE_INPUT = 1 << 30

ACCEPT = np.zeros(256, bool)
ACCEPT[0x30:0x3A] = ACCEPT[0x61:0x7B] = ACCEPT[0x80:] = ACCEPT[0x41:0x5B] = True
FOLD = np.arange(256)
FOLD[0x41:0x5B] += 32
_LOWER = bytes(FOLD.astype(np.uint8))


class Index:
    """Fingerprints and windows of items, as sorted arrays."""

    def __init__(self, items: list[tuple[str, str | None]]):
        texts = pa.array([t or "" for _, t in items], pa.string())
        data, bounds = tk.buffers(texts)
        w = tk.words(data, bounds, 0, len(items), ACCEPT, FOLD)
        count = np.diff(w.first)
        self.names = [i for i, _ in items]
        self.lengths: dict[int, tuple[np.ndarray, list[tuple[bytes, list[int]]]]] = {}
        long = count >= WINDOW
        for size in sorted({WINDOW} & {WINDOW if long.any() else 0} | set(count[(count > 0) & ~long].tolist())):
            kept = long if size == WINDOW else count == size
            at = np.flatnonzero(tk.room(w, size) & kept[w.row[: max(0, len(w.hash) - size + 1)]])
            by: dict[int, dict[bytes, set[int]]] = {}
            for h, i in zip(tk.grams(w, size, True)[at].tolist(), at.tolist(), strict=True):
                by.setdefault(h, {}).setdefault(spell(w, i, size), set()).add(int(w.row[i]))
            keys = np.array(sorted(by), np.uint64)
            self.lengths[size] = keys, [[(s, sorted(x)) for s, x in by[h].items()] for h in keys.tolist()]
        self.prints = np.unique(fingerprints(w)[0]) if long.any() else np.zeros(0, np.uint64)

    def lookup(self, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Position of each x among the keys, or -1."""
        if not len(keys):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, at, -1)


def spell(w: tk.Words, i: int, size: int) -> bytes:
    """The bytes of `size` words from word i on, folded, with one space between."""
    return b" ".join(bytes(w.data[w.start[k] : w.end[k]]).translate(_LOWER) for k in range(i, i + size))


def fingerprints(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Of every whole window in a row: its fingerprint, and its first word."""
    least = tk.sliding_min(tk.grams(w, GRAM), WINDOW - GRAM + 1)
    at = np.flatnonzero(tk.room(w, WINDOW))
    return least[at], at


def found(index: Index, w: tk.Words) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which words are hit, and (row, item) pairs."""
    n = len(w.hash)
    hit, pairs = np.zeros(n, bool), set()
    for size, (keys, windows) in index.lengths.items():
        if n < size:
            continue
        if size == WINDOW:
            least, at = fingerprints(w)
            at = at[index.lookup(index.prints, least) >= 0]
        else:
            at = np.flatnonzero(tk.room(w, size))
        if not len(at):
            continue
        where = index.lookup(keys, tk.grams(w, size, True)[at])
        at, where = at[where >= 0], where[where >= 0]
        row, good = w.row, []
        for i, k in zip(at.tolist(), where.tolist(), strict=True):
            same = next((x for s, x in windows[k] if s == spell(w, i, size)), None)
            if same is not None:
                good.append(i)
                pairs.update((int(row[i]), x) for x in same)
        if good:
            hit |= tk.covered(n, np.array(good), size)
    return hit, sorted(pairs)


def positions(hit: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """Positions in its row of each hit word, a list a row."""
    at = np.flatnonzero(hit)
    lens = np.diff(np.searchsorted(at, first))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(at - np.repeat(first[:-1], lens), pa.int32()))


def small(items: DataFrame, block_bytes: int) -> list[tuple] | None:
    """The items, if their texts have at most that many bytes."""
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > block_bytes:
        return None
    return [tuple(r) for r in items.distinct().collect()]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, positions of the words inside occurring windows, and the items they come from."""
    items = benchmark_items(benchmark)
    rows = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = small(items, block_bytes)
    if held is None:
        return joined(rows, items).drop("digest")
    block = docs.sparkSession.sparkContext.broadcast(Index(held))

    @tidy("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = block.value
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(bounds):
                w = tk.words(data, bounds, lo, hi, ACCEPT, FOLD)
                hit, pairs = found(index, w)
                of: dict[int, list[str]] = {}
                for r, x in pairs:
                    of.setdefault(r, []).append(index.names[x])
                names = [list(dict.fromkeys(of.get(r, []))) for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first), pa.int64()), positions(hit, w.first), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "n_words", "hit_words", "items"])

    return rows.mapInArrow(run, "doc_id long, n_words long, hit_words array<int>, items array<string>")


def windows_of(w: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every run of `size` words in a row: its fingerprint (of a shorter one its own hash), and its first word."""
    if len(w.hash) < size:
        return np.zeros(0, tk.U64), np.zeros(0, np.int64)
    if size == WINDOW:
        return fingerprints(w)
    at = np.flatnonzero(tk.room(w, size))
    return tk.grams(w, size)[at], at


def item_windows(items: DataFrame) -> DataFrame:
    """(size, print, name, words, item_id): the windows of the items, by fingerprint, second hash and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(bounds):
                w = tk.words(data, bounds, lo, hi, ACCEPT, FOLD)
                count = np.diff(w.first)
                for size in sorted(set(np.minimum(count, WINDOW).tolist()) - {0}):
                    prints, at = windows_of(w, size)
                    mine = (np.minimum(count, WINDOW) == size)[w.row[at]]
                    prints, at = prints[mine], at[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size), pa.int32()), pa.array(prints.view(np.int64)), pa.array(tk.grams(w, size, True)[at].view(np.int64)), pa.array([spell(w, i, size) for i in at.tolist()], pa.binary()), batch.column(0).slice(lo, hi - lo).take(pa.array(w.row[at]))], names=["size", "print", "name", "words", "item_id"])

    return items.select("item_id", "text").mapInArrow(run, "size int, print long, name long, words binary, item_id string")


def place(prints: np.ndarray) -> np.ndarray:
    return (tk.mix(prints.view(np.uint64)) >> tk.U64(64 - (FILTER_BITS - 1).bit_length())).astype(np.int64)


def fingerprint_filter(windows: DataFrame, groups: int) -> np.ndarray:
    """FILTER_BITS bits, set where a fingerprint of the items falls."""
    each = FILTER_BITS // FILTER_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(place(batch.column(0).to_numpy()))
            for p in np.unique(at // each):
                yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([(at[at // each == p] - p * each).astype(np.int32).tobytes()], pa.binary())], names=["part", "at"])

    def unite(table: pa.Table) -> tuple:
        return (np.unique(np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("at")])).tobytes(),)

    out = np.zeros((FILTER_PARTS, each // 8), np.uint8)
    for part, at in tree(windows.select("print").mapInArrow(mark, "part int, at binary"), unite, groups).toLocalIterator():
        bits = np.zeros(each, bool)
        bits[np.frombuffer(at, np.int32)] = True
        out[part] = np.packbits(bits)
    return out.reshape(-1)


def joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """hits() by a join of windows, with a digest of the text; rows: doc_id and text."""
    spark = rows.sparkSession
    windows = written(item_windows(items), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # WINDOW numbers at most
    bits = spark.sparkContext.broadcast(fingerprint_filter(windows, input_bytes(items) // MERGE_INPUT))

    @tidy("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            data, bounds = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(bounds):
                w = tk.words(data, bounds, lo, hi, ACCEPT, FOLD)
                asked: list[list[dict]] = [[] for _ in range(hi - lo)]
                for size in sizes:
                    prints, at = windows_of(w, size)
                    spot = place(prints)
                    pass_ = (known[spot >> 3] << (spot & 7).astype(np.uint8)) & 128 > 0
                    prints, at = prints[pass_], at[pass_]
                    name, row = tk.grams(w, size, True), w.row
                    for p, i in zip(prints.view(np.int64).tolist(), at.tolist(), strict=True):
                        r = int(row[i])
                        asked[r].append({"size": size, "print": p, "name": int(name[i : i + 1].view(np.int64)[0]), "words": spell(w, i, size), "at": i - int(w.first[r])})
                kind = pa.list_(pa.struct([("size", pa.int32()), ("print", pa.int64()), ("name", pa.int64()), ("words", pa.binary()), ("at", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(w.first), pa.int64()), pa.array(asked, kind)], names=["doc_id", "digest", "n_words", "asked"])

    read = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).mapInArrow(run, "doc_id long, digest string, n_words long, asked array<struct<size:int,print:long,name:long,words:binary,at:int>>")
    read = written(read, "asked")
    asked = read.where(F.size("asked") > 0).select("doc_id", "digest", F.explode("asked").alias("x")).select("doc_id", "digest", "x.*").distinct()
    met = asked.join(windows, ["size", "print", "name", "words"])
    at = F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)
    words = met.select("doc_id", "digest", "at", "size").distinct().select("doc_id", "digest", F.explode(at).alias("word")).distinct().groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("word")).alias("hit_words"))
    names = met.select("doc_id", "digest", "item_id").distinct().groupBy("doc_id", "digest").agg(F.collect_list("item_id").alias("items"))
    found_ = words.join(names, (words["doc_id"].eqNullSafe(names["doc_id"])) & (words["digest"] == names["digest"])).select(words["doc_id"], words["digest"], "hit_words", "items")
    all_ = read.select("doc_id", "digest", "n_words")
    return all_.join(found_, all_["doc_id"].eqNullSafe(found_["doc_id"]) & (all_["digest"] == found_["digest"]), "left").select(all_["doc_id"], all_["digest"], "n_words", F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text has no window of a benchmark item, with all their columns; rows are judged by their text, not their id."""
    items = benchmark_items(benchmark)
    held = small(items, block_bytes)
    if held is None:
        texts = docs.select(F.lit(0).cast("long").alias("doc_id"), "text")
        bad = joined(texts, items).where(F.size("hit_words") > 0).select(F.col("digest").alias("_bad")).distinct()
        return docs.join(bad, F.sha2(docs["text"], 256) == bad["_bad"], "left_anti")
    block = docs.sparkSession.sparkContext.broadcast(Index(held))
    names, at = docs.columns, docs.columns.index("text")

    @tidy("decontaminate")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tk.buffers(batch.column(at))
            for lo, hi in tk.slices(bounds):
                w = tk.words(data, bounds, lo, hi, ACCEPT, FOLD)
                hit, _ = found(block.value, w)
                upto = np.concatenate(([0], np.cumsum(hit)))[w.first]
                yield pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns, names=names).filter(pa.array(np.diff(upto) == 0))

    return short_batches(docs).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    h = hits(docs, bench)
    return h.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The contract in DuckDB's SQL: windows by their own words.  For small tables; every window is a string.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS x FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS y FROM benchmark),
v AS (SELECT DISTINCT item, size, array_to_string(y[i:i + size - 1], ' ') AS s FROM (SELECT item, y, least({WINDOW}, len(y)) AS size, unnest(range(1, len(y) - least({WINDOW}, len(y)) + 2)) AS i FROM b WHERE len(y) > 0)),
w AS (SELECT rid, size, i, array_to_string(x[i:i + size - 1], ' ') AS s FROM (SELECT rid, x, size, unnest(range(1, len(x) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM v))),
h AS (SELECT rid, size, i, item FROM w JOIN v USING (size, s)),
p AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + size)) AS p FROM h) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN n USING (rid)
"""


def brute(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]]) -> list[tuple]:
    """The contract read literally, for tests."""
    import re

    def cut(t: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    windows = []
    for name, t in items:
        x = cut(t)
        size = min(WINDOW, len(x))
        if size:
            windows += [(name, x[i : i + size]) for i in range(len(x) - size + 1)]
    out = []
    for d, t in docs:
        x, hit, names = cut(t), set(), set()
        for name, y in windows:
            for i in range(len(x) - len(y) + 1):
                if x[i : i + len(y)] == y:
                    hit.update(range(i, i + len(y)))
                    names.add(name)
        out.append((d, len(x), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
