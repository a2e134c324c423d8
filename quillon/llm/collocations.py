"""Phrase collocation mining with word-id suffix arrays.

1. Documents are dealt to shards.  A shard numbers its words (a word is that of its language)
   and cuts them into pieces.  Phrases of two words that occur fewer than LEAST times in all can
   be in no candidate, so before phrases are counted each shard asks, for the hash of each of its word
   pairs, whether the sum over all shards reaches LEAST; pairs are dealt by hash range and answered by one bit.
   A hash shared by two pairs only lets more of them pass.
2. Each shard cuts its pieces where a pair didn't pass, and builds the suffix array of what is left
   by numpy prefix doubling, to the depth of LONGEST words.  Neighbours in it share a number
   of words; intervals over which at least n are shared are the phrases of n words, and their
   widths the counts.  Only these go into the shuffle, once a shard, and are summed by language and phrase.
3. Phrases of LEAST occurrences or more are written as a table.  A candidate's parts and its
   longer candidates are such phrases too, so scores and coverage are joins of this table with itself,
   the latter after a maximum by phrase.  Each language's best are found per salt first.

Defined cases: null and empty texts have no words; null languages are `und`; repeated rows and
rows of null ids count each; texts of any length are counted whole; ties of score go to the larger count,
then to the smaller phrase in byte order; a language without candidates gives no row, an empty table none;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.decontaminate import FOLD, _LOWER
from quillon.llm.runtime import documents, input_bytes, short_batches, written

LONGEST, LEAST, COVERED, BEST, UNDETERMINED = 4, 30, 80, 2000, "und"
SCALE = 2_000_000
SHARD_BYTES = 6 << 20
#: Salts of a language's candidates before the last ranking.
SALTS = 64

ENDS = np.zeros(256, bool)
ENDS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
ACCEPT = ~ENDS
ACCEPT[[0x20, 0x09]] = False


class Shard:
    """Words of a shard's documents by number, and where pieces end."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.data, self.bounds = tk.buffers(table.column("text"))
        codes = table.column("lang").fill_null(UNDETERMINED).combine_chunks().dictionary_encode()
        if isinstance(codes, pa.ChunkedArray):
            codes = codes.combine_chunks()
        self.langs, lang_of_row = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
        salt = tk.mix(np.array([int.from_bytes(x.encode().ljust(8, b"\0")[:8], "little") ^ hash_of(x) for x in self.langs.to_pylist()], np.uint64))
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("h1", "h2", "lang", "start", "end", "tie")}
        for lo, hi in tk.slices(self.bounds):
            w = tk.words(self.data, self.bounds, lo, hi, ACCEPT, FOLD)
            if not len(w.start):
                continue
            lang = lang_of_row[lo:hi][w.row]
            stops = np.concatenate(([0], np.cumsum(ENDS[w.data])))[w.start]
            tie = np.zeros(len(w.start), bool)  # a word that the next one follows in the same piece
            tie[:-1] = (w.row[1:] == w.row[:-1]) & (stops[1:] == stops[:-1])
            for k, x in (("h1", tk.mix(w.hash ^ salt[lang])), ("h2", tk.mix(w.second + salt[lang])), ("lang", lang), ("start", w.start + self.bounds[lo]), ("end", w.end + self.bounds[lo]), ("tie", tie)):
                parts[k].append(x)
        kinds = {"h1": np.uint64, "h2": np.uint64, "tie": bool}
        self.h1, self.h2, self.lang, self.start, self.end, self.tie = (np.concatenate(x) if x else np.zeros(0, kinds.get(k, np.int64)) for k, x in parts.items())

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The shard's distinct word pairs as hashes of `bits` + 32 bits in order, their counts, where pairs stand, and which one each is."""
        at = np.flatnonzero(self.tie)
        key = tk.mix(self.h1[at] * tk.U64(tk.WORD_BASE) + self.h1[at + 1]) >> tk.U64(32 - bits)
        names, which, count = np.unique(key, return_inverse=True, return_counts=True)
        return names, count, at, which

    def numbers(self) -> np.ndarray:
        """A number from 1 for each distinct word, told apart by both of its hashes."""
        order = np.lexsort((self.h2, self.h1))
        a, b = self.h1[order], self.h2[order]
        new = np.ones(len(order), np.int64)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(new)
        return out

    def spell(self, first: np.ndarray, words: int) -> list[str]:
        """The phrase of `words` words from each position on, folded, with one space between."""
        raw = self.data.tobytes().translate(_LOWER)
        cut = [[raw[a:b] for a, b in zip(self.start[first + k].tolist(), self.end[first + k].tolist(), strict=True)] for k in range(words)]
        return [b" ".join(x).decode() for x in zip(*cut, strict=True)]


def hash_of(name: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(name.encode(), digest_size=8).digest(), "little")


def ranks(key: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones, from 1."""
    return np.unique(key, return_inverse=True)[1] + 1


def suffix_array(number: np.ndarray, tie: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by at least the `depth` words that follow, and how many words each shares with its neighbour before.

    Prefix doubling: ranks by 2k words are ranks of pairs of ranks by k words.  A suffix ends where
    its piece does; words beyond count as 0.
    """
    n = len(number)
    room = np.ones(n, np.int64)  # words from here to the end of the piece
    for k in range(1, min(depth, n)):
        room[: n - k] += (room[: n - k] == k) & tie[k - 1 : n - 1]
    by = {1: number}
    while max(by) < depth:
        k = max(by)
        after = np.where(room[: n - k] > k, by[k][k:], 0) if n > k else np.zeros(0, np.int64)
        by[2 * k] = ranks((by[k] << 32) | np.concatenate((after, np.zeros(n - len(after), np.int64))))
    order = np.lexsort([by[max(by)]])
    shared = np.zeros(n, np.int64)
    at, before = order[1:], order[:-1]
    live = np.ones(max(0, n - 1), bool)
    for j in range(depth):  # the next word of both, while they agree and neither's piece has ended
        live = live & (room[at] > j) & (room[before] > j)
        k = np.flatnonzero(live)
        live[k] = number[at[k] + j] == number[before[k] + j]
        shared[1:][live] = j + 1
    return order, shared


def intervals(order: np.ndarray, shared: np.ndarray, tie: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each phrase of `words` words: a position where it stands, and its count."""
    whole = np.ones(len(order), bool)
    for j in range(words - 1):
        whole &= np.append(tie[j:], np.zeros(j, bool))[: len(order)]
    lead = np.flatnonzero(shared < words)
    width = np.add.reduceat(whole[order], lead) if len(lead) else np.zeros(0, np.int64)
    first, some = order[lead], width > 0
    return first[some], width[some]


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """How often phrases of up to `longest` words occur: lang, phrase, words, f; all that occur `least` times or more, and the words of a language as phrase null."""
    spark = short_batches(docs).sparkSession
    n_shards = max(96, input_bytes(docs) // shard_bytes + 1)
    bits = max(6, (n_shards - 1).bit_length())
    n = max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_shards)).cast("int").alias("shard")).repartition(n, "shard")

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        names, count, _, _ = Shard(table).pairs(bits)
        part = names >> tk.U64(32)
        cut = np.flatnonzero(np.diff(part, prepend=tk.U64(1 << 63)))
        each = list(zip(cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True)) if len(part) else []
        low, few = (names & tk.U64(0xFFFFFFFF)).astype(np.uint32), np.minimum(count, least).astype(np.uint32)
        return pa.table({"part": pa.array(part[[a for a, _ in each]].astype(np.int32)), "shard": pa.array([key[0].as_py()] * len(each), pa.int32()), "low": pa.array([tk.planes(low[a:b]) for a, b in each], pa.binary()), "n": pa.array([tk.planes(few[a:b]) for a, b in each], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        low, few = ([tk.unplanes(x.as_py(), np.uint32) for x in table.column(c)] for c in ("low", "n"))
        _, which = np.unique(np.concatenate(low), return_inverse=True)
        often = (np.bincount(which, np.concatenate(few)) >= least)[which]
        cut = np.cumsum([0, *map(len, low)])
        return pa.table({"shard": table.column("shard"), "part": pa.array([key[0].as_py()] * table.num_rows, pa.int32()), "n": pa.array(np.diff(cut), pa.int32()), "bits": pa.array([np.packbits(often[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left)
        _, _, at, which = s.pairs(bits)
        told = sorted(zip(right.column("part").to_pylist(), right.column("n").to_pylist(), right.column("bits").to_pylist(), strict=True))
        often = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=m).astype(bool) for _, m, b in told)])
        tie = s.tie.copy()
        tie[at] = often[which]
        order, shared = suffix_array(s.numbers(), tie, longest)
        lang, phrase, words, f = [s.langs], [pa.nulls(len(s.langs), pa.string())], [np.zeros(len(s.langs), np.int32)], [np.bincount(s.lang, minlength=len(s.langs))]
        for k in range(1, longest + 1):
            first, width = intervals(order, shared, tie, k)
            lang.append(s.langs.take(pa.array(s.lang[first])))
            phrase.append(pa.array(s.spell(first, k), pa.string()))
            words.append(np.full(len(first), k, np.int32))
            f.append(width)
        return pa.table({"lang": pa.concat_arrays(lang), "phrase": pa.concat_arrays(phrase), "words": pa.array(np.concatenate(words)), "f": pa.array(np.concatenate(f).astype(np.int64))})

    told = dealt.groupBy("shard").applyInArrow(ask, "part int, shard int, low binary, n binary").groupBy("part").applyInArrow(answer, "shard int, part int, n int, bits binary")
    parts = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(count, "lang string, phrase string, words int, f long")
    return parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("phrase").isNull() | (F.col("f") >= least))


def sub_phrase(start: int, words: int):
    return F.array_join(F.slice("x", start, words), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, best: int = BEST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The `best` phrases of each language by their weakest cut: lang, rank, phrase, a, l, r, n, score."""
    table = written(phrase_counts(docs, longest, least, shard_bytes), "phrases")
    known = table.where("phrase is not null")
    sizes = table.where("phrase is null").select("lang", F.col("f").alias("n"))
    some = known.where("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "words").withColumn("x", F.split("phrase", " ", -1))

    cuts = some.select("lang", "phrase", "a", "x", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", sub_phrase(1, F.col("k")).alias("head"), sub_phrase(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    part = known.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of"))
    cuts = cuts.join(part.withColumnsRenamed({"part": "head", "of": "l"}), ["lang", "head"]).join(part.withColumnsRenamed({"part": "rest", "of": "r"}), ["lang", "rest"])
    score = F.expr(f"cast({SCALE} as decimal(20,0)) * cast(a as decimal(18,0)) div (l + r)")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("x", i, m), " "))))
    over = some.where("words >= 3").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(over, ["lang", "phrase"], "left").where(f"longer is null or cast(100 as decimal(20,0)) * longer < cast({covered} as decimal(20,0)) * a")

    place = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*place))).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*place)).cast("long")).where(F.col("rank") <= best)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


#: The contract in DuckDB's SQL.
SQL = f"""
WITH p AS MATERIALIZED (SELECT coalesce(lang, '{UNDETERMINED}') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS x FROM documents),
t AS (SELECT lang, sum(len(x)) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS f FROM (SELECT lang, m, array_to_string(x[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, x, m, unnest(range(1, len(x) - m + 2)) AS i FROM p, range(1, {LONGEST + 1}) r(m))) GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS x FROM f WHERE m >= 2),
k AS (SELECT lang, phrase, a, k, array_to_string(x[1:k], ' ') AS head, array_to_string(x[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, h.f AS l, r.f AS r, CAST({SCALE}::HUGEINT * k.a // (h.f + r.f) AS BIGINT) AS score FROM k JOIN f h ON h.lang = k.lang AND h.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.rest),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(x[i:i + w - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - w + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS w FROM c))) GROUP BY lang, phrase),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < {COVERED}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM z JOIN t USING (lang) WHERE rank <= {BEST}
"""


def brute(docs: list[tuple[str | None, str | None]], longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, best: int = BEST) -> list[tuple]:
    """The contract read literally, for tests."""
    f: dict[str, Counter] = {}
    n: Counter = Counter()
    for lang, t in docs:
        lang = UNDETERMINED if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            x = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(x)
            f.setdefault(lang, Counter()).update(x[i : i + m] for m in range(1, longest + 1) for i in range(len(x) - m + 1))
    out = []
    for lang, of in f.items():
        found = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items() if len(q) > len(p)):
                continue
            score, k = min((SCALE * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            kept.append((score, a, " ".join(p), of[p[:k]], of[p[k:]]))
        kept.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(kept[:best])]
    return out
