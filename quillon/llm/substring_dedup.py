"""Substring dedup: a word goes if a window of WINDOW words over it also starts in a document of smaller id.

1. Sketch.  Each window gets a cell by a hash of its content: the least hash among its
   GRAM-word pieces, so that neighbouring windows mostly share a cell and one entry stands
   for the run.  Every partition counts the documents of each of its cells; the partition
   sketches are merged by cell range, in a tree.  A cell's count is never under the number of
   documents that hold the window, so windows whose cell counts one document are unique.
   Only one bit a cell (two documents or more) comes back; the sketch has at most
   MAX_CELLS cells, 128 MB of bits.  More text than that serves only weakens the filter.
2. Exact grouping.  Documents are dealt to buckets.  A bucket names each window estimated
   as repeated once, with its least document (so copies collapse before the shuffle), by two
   64-bit hashes that start from different hashes of its words; the names are dealt by hash
   range, in proportion to the buckets, where the least document of all buckets is found.  Answers of one bit a name go back to the bucket.
3. The bucket finds its windows again, marks those whose first document is smaller, and
   takes the covered words out.

A window's name is dealt once per bucket, however many documents hold it, so a group of
copies never meets in one task.  Every step is deterministic, so a lost task can run again.

Defined cases: null or empty texts have no words; ids that repeat count as one document, and each
of their rows gives a row; rows without an id go by the id 0; a document of fewer than WINDOW words
loses nothing; an empty table gives no rows; texts of any length are read whole; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.runtime import documents, input_bytes, short_batches, tidy, tree

WINDOW, GRAM = 50, 10
#: Most cells of the merged sketch (one bit of each is broadcast).
MAX_CELLS = 1 << 30
CELLS_A_BYTE = 0.25
BUCKET_BYTES = 6 << 20
#: Entries that a task holds before it writes its partial sketch.
FLUSH = 4 << 20
#: Input bytes for each group of the first level of the sketch's merge.
MERGE_INPUT = 1 << 30

ACCEPT = np.ones(256, bool)
ACCEPT[[0x20, *range(0x09, 0x0E)]] = False


def sizes(docs: DataFrame, cells_a_byte: float, bucket_bytes: int) -> tuple[int, int]:
    """log2 of the sketch's cells, and the number of buckets, from the input's bytes."""
    n = input_bytes(docs)
    bits = max(20, min(MAX_CELLS.bit_length() - 1, int(np.ceil(np.log2(max(1.0, n * cells_a_byte))))))
    return bits, max(96, int(n // bucket_bytes) + 1)


def cells(w: tk.Words, bits: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window in a row: its first word and its cell."""
    least = tk.sliding_min(tk.grams(w, gram), window - gram + 1)
    at = np.flatnonzero(tk.room(w, window))
    return at, tk.mix(least[at]) >> tk.U64(64 - bits)


def sketch(docs: DataFrame, bits: int, window: int, gram: int, groups: int = 1) -> bytes:
    """One bit a cell: whether the merged count is two documents or more."""
    part_bits = min(bits - 3, max(8, bits - 20))
    inner = bits - part_bits

    @tidy("substring_dedup")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            got, n = np.unique(np.concatenate(held), return_counts=True)
            part = got >> tk.U64(inner)
            cut = np.flatnonzero(np.diff(part, prepend=tk.U64(1 << 63)))
            end = np.append(cut[1:], len(part))
            low, n = (got & tk.U64((1 << inner) - 1)).astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())], names=["part", "cell", "n"])

        for batch in batches:
            data, bounds = tk.buffers(batch.column(0))
            for lo, hi in tk.slices(bounds):
                w = tk.words(data, bounds, lo, hi, ACCEPT)
                at, cell = cells(w, bits, window, gram)
                if len(at):
                    row = w.row[at]
                    new = np.ones(len(at), bool)
                    new[1:] = (cell[1:] != cell[:-1]) | (row[1:] != row[:-1])
                    held.append(cell[new])
            if sum(map(len, held)) > FLUSH:
                yield flush()
        if held:
            yield flush()

    def merge(table: pa.Table) -> tuple:
        total = np.zeros(1 << inner, np.int64)
        for c, n in zip(table.column("cell"), table.column("n"), strict=True):
            total[np.frombuffer(c.as_py(), np.uint32)] += np.frombuffer(n.as_py(), np.uint8)
        some = np.flatnonzero(total)
        return some.astype(np.uint32).tobytes(), np.minimum(total[some], 255).astype(np.uint8).tobytes()

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                often = np.zeros(1 << inner, bool)
                often[np.frombuffer(c, np.uint32)] = np.frombuffer(n, np.uint8) > 1
                out.append(np.packbits(often).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["part", "bits"])

    parts = tree(docs.select("text").mapInArrow(count, "part int, cell binary, n binary"), merge, groups).mapInArrow(known, "part int, bits binary")
    out, each = np.zeros(1 << (bits - 3), np.uint8), 1 << (inner - 3)
    for part, got in parts.toLocalIterator(prefetchPartitions=True) if bits > 28 else parts.collect():
        out[part * each : (part + 1) * each] = np.frombuffer(got, np.uint8)
    return out.tobytes()


class Candidates:
    """Windows of a bucket's documents that the sketch estimates as repeated, grouped by name."""

    def __init__(self, table: pa.Table, bits: int, held: bytes, window: int, gram: int):
        table = table.combine_chunks()
        self.names = table.column("doc_id")
        self.ids = self.names.fill_null(0).to_numpy()
        self.data, self.bounds = tk.buffers(table.column("text"))
        known = np.frombuffer(held, np.uint8)
        self.found: list[tuple[int, int, np.ndarray]] = []
        h1, h2, doc = [], [], []
        for lo, hi in tk.slices(self.bounds):
            w = tk.words(self.data, self.bounds, lo, hi, ACCEPT)
            at, cell = cells(w, bits, window, gram)
            at = at[(known[cell >> tk.U64(3)] << (cell & tk.U64(7)).astype(np.uint8)) & 128 > 0]
            self.found.append((lo, hi, at))
            if len(at):
                h1.append(tk.grams(w, window)[at])
                h2.append(tk.grams(w, window, True)[at])
                doc.append(self.ids[lo:hi][w.row[at]])
        self.h1, self.h2, self.doc = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h1, np.uint64), (h2, np.uint64), (doc, np.int64)))
        self.order, self.group, self.lead = grouped(self.h1, self.h2, self.doc)


def grouped(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by name and document; the group of each in that order; where each group starts, which is its least document."""
    order = np.lexsort((doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells_a_byte: float = CELLS_A_BYTE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: its words, how many are repeated from smaller ids, and the text without them."""
    spark = short_batches(docs).sparkSession
    bits, n_buckets = sizes(docs, cells_a_byte, bucket_bytes)
    slice_bits = max(6, (n_buckets - 1).bit_length())
    known = spark.sparkContext.broadcast(sketch(docs, bits, window, gram, n_buckets * bucket_bytes // MERGE_INPUT))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)).cast("int").alias("bucket"))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        c = Candidates(table, bits, known.value, window, gram)
        first = c.order[c.lead]
        h1, h2, doc = c.h1[first], c.h2[first], c.doc[first]
        part = h1 >> tk.U64(64 - slice_bits)
        cut = np.flatnonzero(np.diff(part, prepend=tk.U64(1 << 63)))
        end = np.append(cut[1:], len(part))
        each = list(zip(cut.tolist(), end.tolist(), strict=True)) if len(part) else []
        return pa.table({
            "part": pa.array(part[[a for a, _ in each]].astype(np.int32)), "bucket": pa.array([key[0].as_py()] * len(each), pa.int32()),
            "h1": pa.array([h1[a:b].tobytes() for a, b in each], pa.binary()), "h2": pa.array([h2[a:b].tobytes() for a, b in each], pa.binary()), "doc": pa.array([tk.planes(doc[a:b]) for a, b in each], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        cols = [[np.frombuffer(x.as_py(), t) for x in table.column(n)] for n, t in (("h1", np.uint64), ("h2", np.uint64))]
        docs_of = [tk.unplanes(x.as_py(), np.int64) for x in table.column("doc")]
        doc = np.concatenate(docs_of)
        order, group, lead = grouped(np.concatenate(cols[0]), np.concatenate(cols[1]), doc)
        before = np.empty(len(doc), bool)
        before[order] = doc[order] > doc[order[lead]][group]
        cut = np.cumsum([0, *map(len, docs_of)])
        return pa.table({"bucket": table.column("bucket"), "part": pa.array([key[0].as_py()] * table.num_rows, pa.int32()), "n": pa.array(np.diff(cut), pa.int32()), "bits": pa.array([np.packbits(before[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Candidates(left, bits, known.value, window, gram)
        told = sorted(zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("bits").to_pylist(), strict=True))
        elsewhere = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in told)])
        flag = np.zeros(len(c.doc), bool)
        if len(c.doc):
            flag[c.order] = elsewhere[c.group] | (c.doc[c.order] > c.doc[c.order[c.lead]][c.group])
        out, done = [], 0
        for lo, hi, at in c.found:
            w = tk.words(c.data, c.bounds, lo, hi, ACCEPT)
            gone = tk.covered(len(w.hash), at[flag[done : done + len(at)]], window)
            done += len(at)
            out.append(pa.table({"doc_id": c.names.slice(lo, hi - lo), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_removed": pa.array(np.diff(np.concatenate(([0], np.cumsum(gone)))[w.first]), pa.int64()), "kept": kept(w, ~gone)}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    n = max(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartition(n, "bucket")
    asked = dealt.groupBy("bucket").applyInArrow(ask, "part int, bucket int, h1 binary, h2 binary, doc binary")
    told = asked.groupBy("part").applyInArrow(answer, "bucket int, part int, n int, bits binary")
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(cut_out, "doc_id long, n_words long, n_removed long, kept string")


def kept(w: tk.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    n = len(w.data)
    mark = np.zeros(n + 2, np.int8)
    s, e = w.start[keep], w.end[keep]
    after = np.cumsum(np.concatenate(([0], keep)))[w.first]
    last = np.zeros(len(s), bool)
    last[after[1:][after[1:] > after[:-1]] - 1] = True
    np.add.at(mark, s, 1)
    np.add.at(mark, e + ~last, -1)
    take = np.cumsum(mark[:n], dtype=np.int8) > 0
    spaced = np.where(ACCEPT[w.data], w.data, np.uint8(0x20))[take]
    size = np.concatenate(([0], np.cumsum(take)))[w.bounds]
    return pa.Array.from_buffers(pa.string(), len(w.bounds) - 1, [None, pa.py_buffer(size.astype(np.int32)), pa.py_buffer(spaced)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repeats(documents(spark, sf_dir))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The contract in DuckDB's SQL: windows by their own words.  For small tables; every window is a string.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS x FROM documents),
w AS (SELECT rid, doc_id, i, md5(array_to_string(x[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT rid, doc_id, x, unnest(range(1, len(x) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT h, min(doc_id) AS first FROM w GROUP BY h HAVING count(*) > 1),
r AS (SELECT DISTINCT rid, unnest(range(i, i + {WINDOW})) AS p FROM w JOIN f USING (h) WHERE doc_id > first),
k AS (SELECT d.rid, count(r.p) AS n_removed, string_agg(CASE WHEN r.p IS NULL THEN d.t END, ' ' ORDER BY d.p) AS kept FROM (SELECT rid, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS p FROM d) d LEFT JOIN r ON d.rid = r.rid AND d.p = r.p GROUP BY d.rid)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""


def brute(docs: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract read literally, for tests."""
    import re

    cut = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    first: dict[tuple, int] = {}
    for d, x in cut:
        for i in range(len(x) - window + 1):
            k = tuple(x[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, x in cut:
        gone = {j for i in range(len(x) - window + 1) if first[tuple(x[i : i + window])] < d for j in range(i, i + window)}
        left = " ".join(y for j, y in enumerate(x) if j not in gone)
        out.append((d, len(x), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out
