"""Token counts by rank-synchronous array merging, without the ids.

Pre-tokens of a batch lie in one ragged array of symbol ids.  In each round every sequence
finds the least rank among its adjacent pairs and joins all pairs of that rank at once, from
the left where they overlap; sequences without a pair drop out.  What remains of a sequence
is its count.  A merge always has a higher rank than the merges that made its parts, so
joining all pairs of the least rank at once gives what joining them one by one does.

Defined cases: a null text is empty and has no tokens; the special token's string inside a
text counts one, as the library does by default; texts are counted whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.byte_bpe import byte_table, runs
from quillon.llm.pretokens import Table
from quillon.llm.runtime import documents, resident, short_batches, tidy

VOCABULARY, LIMIT = "byte_bpe_50k.json", 512
#: The pattern of the byte-level pre-tokenizer; its white space is Unicode's property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Symbols in one ragged array, but for a longer pre-token, which stands alone.
SYMBOLS = 1 << 20


class Merger:
    """Pair ranks of one vocabulary, as sorted arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, merges = j["model"]["vocab"], j["model"]["merges"]
        self.special = [t["content"] for t in j["added_tokens"] if t["special"]]
        self.pattern = regex.compile(PRETOKEN)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.symbol = np.array([vocab[c] for c in byte_table()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pieces = Table(self.count_chunks)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.order[at], len(self.key))

    def survivors(self, symbols: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many symbols each sequence keeps; symbols: all sequences end to end, each of at least one symbol."""
        none, out = len(self.key), size.copy()
        seq = np.arange(len(size))
        while len(symbols) > 1:
            of = np.repeat(np.arange(len(seq)), size)
            rank = np.full(len(symbols), none)
            same = of[:-1] == of[1:]
            rank[:-1][same] = self.ranks(symbols[:-1][same], symbols[1:][same])
            start = np.concatenate(([0], np.cumsum(size)[:-1]))
            least = np.minimum.reduceat(rank, start)
            on = least < none
            if not on.any():
                break
            if not on.all():
                stay = on[of]
                symbols, rank, seq, size, least = symbols[stay], rank[stay], seq[on], size[on], least[on]
                of = np.repeat(np.arange(len(seq)), size)
            join = rank == least[of]
            if (join[1:] & join[:-1]).any():
                at = np.flatnonzero(join)
                new = np.ones(len(at), bool)
                new[1:] = np.diff(at) > 1
                lead = np.flatnonzero(new)
                nth = np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))
                join[at[nth % 2 == 1]] = False
            at = np.flatnonzero(join)
            symbols = symbols.copy()
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols = symbols[stay]
            size = size - np.bincount(of[at], minlength=len(seq))
            out[seq] = size
        return out

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk: its pre-tokens are merged together with all others of the call."""
        parts, many = [], []
        for c in chunks:
            p = self.pattern.findall(c)
            parts += p
            many.append(len(p))
        distinct = list(dict.fromkeys(parts))
        count: dict[str, int] = {}
        for r in runs(distinct, SYMBOLS):
            raw = [p.encode() for p in r]
            got = self.survivors(self.symbol[np.frombuffer(b"".join(raw), np.uint8)], np.array(list(map(len, raw))))
            count.update(zip(r, got.tolist(), strict=True))
        ends = np.concatenate(([0], np.cumsum([count[p] for p in parts], dtype=np.int64)))
        cut = np.concatenate(([0], np.cumsum(many, dtype=np.int64)))
        return np.diff(ends[cut]).tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text, special strings included."""
        plain, owner, out = [], [], [0] * len(texts)
        for k, t in enumerate(texts):
            if any(s in t for s in self.special):
                out[k] += len(self.special_pattern.findall(t))
                for p in self.special_pattern.split(t):
                    plain.append(p)
                    owner.append(k)
            else:
                plain.append(t)
                owner.append(k)
        for k, c in zip(owner, self.pieces.of(plain), strict=True):
            out[k] += sum(c)
        return out


def merger(path: str) -> Merger:
    return resident("token_count", path, lambda: Merger(path))


def count_tokens(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, bytes and tokens of the whole text."""

    @tidy("token_count")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(public_tokenizers.path(name))
        for batch in batches:
            _, bounds = tk.buffers(batch.column(1))
            for lo, hi in tk.slices(bounds):
                part = batch.slice(lo, hi - lo)
                n: list[int] = []
                for r in runs([t or "" for t in part.column(1).to_pylist()]):
                    n += m.count(r)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds[lo : hi + 1])), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > LIMIT)
