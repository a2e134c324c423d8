"""BPE with word ends: encoding and decoding by merge rounds over numpy arrays.

A text is cut at white space, lower-cased and composed, and cut into pre-tokens; the bytes of
a pre-token are its first symbols, the last one marked as a word's end.  The symbols of all
words of a call lie in one flat array.  In each round the rank of every pair that a merge
has changed is found by binary search over the sorted pair keys, each word's lowest-rank
pair is joined wherever it stands in the word, from the left where it overlaps itself, and
words without a pair leave the array.  A merge outranks the merges that made its parts, so
joining all places of a word's lowest pair in one round gives what joining one by one does.

Decoding gives the library's form for a vocabulary without a decoder: the spellings of the
ids, joined by one space.

Defined cases: a null text is an empty one and gives no ids and an empty decoded text; strings
of special tokens inside texts become these tokens, as the library does by default; texts of
any length are encoded whole; an empty table gives no rows; rows, repeated ones and those of
null ids too, keep their number; ties of rank in a word are joined from the left; columns of the
input that are named like an output column are replaced, others are kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import textkit as tk
from quillon.llm.byte_bpe import byte_table, runs
from quillon.llm.pretokens import Table
from quillon.llm.runtime import documents, resident, short_batches, tidy

VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's pattern; its white space is Unicode's property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Python's split takes these as white space, Unicode's property doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
#: Symbols in one flat array, but for a longer word, which stands alone.
SYMBOLS = 1 << 20


def lower(t: str) -> str:
    """Composed and lower-cased character by character: the sigma at a word's end has no form of its own."""
    return unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()


class Vocabulary:
    """Symbols, sorted pair keys and spellings of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        vocab, end = j["model"]["vocab"], j["model"]["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.path, self.pattern = path, regex.compile(PRETOKEN)
        self.special, self.special_id = regex.compile("|".join(map(regex.escape, special)) or r"(?!)"), special
        self.inner, self.last = (np.array([vocab[c + s] for c in byte_table()], np.int64) for s in ("", end))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in j["model"]["merges"]]
        key = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        self.rank_of = np.argsort(key, kind="stable")
        self.key = key[self.rank_of]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pieces = Table(self.chunks, lambda t: [t] if SEPARATORS.search(t) else t.split())
        spelt = {i: t for t, i in {**vocab, **special}.items()}
        self.spelling = pa.array([spelt.get(i) for i in range(max(spelt) + 1)], pa.string())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; as many as there are merges where it is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank_of[at], len(self.key))

    def merged(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that words end with, end to end, and how many each has; size: at least one symbol a word."""
        none = len(self.key)
        word = np.arange(len(size))
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), none)
        rank[np.cumsum(size) - 1] = none
        left: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            on = least < none
            if not on.all():
                stay = np.repeat(on, size)
                left.append((word[~on], size[~on], symbols[~stay]))
                word, size, least, symbols, rank = word[on], size[on], least[on], symbols[stay], rank[stay]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) > 1
            if not new.all():  # a run of overlapping pairs: every second one
                lead = np.flatnonzero(new)
                nth = np.arange(len(at)) - np.repeat(lead, np.diff(np.append(lead, len(at))))
                at = at[nth % 2 == 0]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            ends = rank[at] == none
            place = np.cumsum(stay) - 1
            final = np.cumsum(size) - 1
            size = size - np.add.reduceat(~stay, final - size + 1)
            symbols, rank, at = symbols[stay], rank[stay], place[at]
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(size) - 1] = True
            for x in (at[~(ends & last[at])], at[at > 0] - 1):
                x = x[~last[x]]
                rank[x] = self.ranks(symbols[x], symbols[x + 1])
        words, sizes, flat = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.argsort(words)
        start = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        return flat[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def pretokens(self, chunk: str) -> list[str]:
        """The words of a chunk.  Characters that Python's Unicode tables don't know yet are told apart by the library's, which may be younger."""
        if chunk.isascii():
            return self.pattern.findall(chunk.lower())
        if "Cn" in map(unicodedata.category, chunk):
            t = self.library.normalizer.normalize_str(chunk)
            return [t[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(t)]
        return self.pattern.findall(lower(chunk))

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as bytes; its words are merged together with all others of the call."""
        words, many = [], []
        for c in chunks:
            x = self.pretokens(c)
            words += x
            many.append(len(x))
        distinct = list(dict.fromkeys(words))
        ids: dict[str, bytes] = {}
        for r in runs(distinct, SYMBOLS):
            raw = [w.encode() for w in r]
            size = np.array(list(map(len, raw)))
            data = np.frombuffer(b"".join(raw), np.uint8)
            symbols = self.inner[data]
            end = np.cumsum(size) - 1
            symbols[end] = self.last[data[end]]
            flat, size = self.merged(symbols, size)
            held, cut = flat.astype("<u4").tobytes(), [0, *(4 * np.cumsum(size)).tolist()]
            ids.update((w, held[a:b]) for w, a, b in zip(r, cut, cut[1:], strict=False))
        out, at = [], 0
        for n in many:
            out.append(b"".join([ids[w] for w in words[at : at + n]]))
            at += n
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        parts, owner, out = [], [], [[] for _ in texts]
        for k, t in enumerate(texts):
            at = 0
            for m in self.special.finditer(t) if "<|" in t else ():
                parts.append(t[at : m.start()])
                owner.append((k, self.special_id[m[0]]))
                at = m.end()
            parts.append(t[at:])
            owner.append((k, None))
        for (k, special), ids in zip(owner, self.pieces.of(parts), strict=True):
            out[k] += ids
            if special is not None:
                out[k].append(special.to_bytes(4, "little"))
        return [b"".join(x) for x in out]

    def decode(self, ids: list[bytes]) -> pa.Array:
        """The spellings of each row's ids, joined by one space; ids that the vocabulary hasn't give nothing."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        cut = np.cumsum([0, *(len(x) // 4 for x in ids)])
        known = flat < len(self.spelling)
        if not known.all() or self.spelling.null_count:
            known[known] = ~np.asarray(self.spelling.is_null())[flat[known]]
            cut, flat = np.concatenate(([0], np.cumsum(known)))[cut], flat[known]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), self.spelling.take(pa.array(flat))), " ")


def vocabulary(path: str) -> Vocabulary:
    return resident("word_bpe", path, lambda: Vocabulary(path))


def encode(docs: DataFrame, name: str = VOCABULARY, round_trip: bool = False) -> DataFrame:
    """The documents with `ids`, the ids of the whole text as little-endian unsigned 32-bit integers in one binary.

    round_trip: instead of the text, `decoded`, what decoding the ids gives, made in the same pass.
    """
    taken = ("ids", "decoded") if round_trip else ("ids",)
    read = [c for c in docs.columns if c not in taken]
    keep = [c for c in read if not (round_trip and c == "text")]
    more = [T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.StringType(), False)][: len(taken)]

    @tidy("word_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(public_tokenizers.path(name))
        for batch in batches:
            k = batch.schema.get_field_index("text")
            _, bounds = tk.buffers(batch.column(k))
            for lo, hi in tk.slices(bounds):
                part = batch.slice(lo, hi - lo)
                ids: list[bytes] = []
                for r in runs([t or "" for t in part.column(k).to_pylist()]):
                    ids += v.encode(r)
                made = [pa.array(ids, pa.binary())]
                if round_trip:
                    made.append(v.decode(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in keep), *made], names=[*keep, *taken])

    return short_batches(docs).select(read).mapInArrow(run, T.StructType([*docs.select(keep).schema.fields, *more]))


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The rows with `decoded`, the text that their ids stand for; null ids give an empty one."""
    keep = [c for c in encoded.columns if c != "decoded"]

    @tidy("word_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(public_tokenizers.path(name))
        for batch in batches:
            ids = [x or b"" for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, v.decode(ids)], names=[*keep, "decoded"])

    return short_batches(encoded).select(keep).mapInArrow(run, T.StructType([*encoded.select(keep).schema.fields, T.StructField("decoded", T.StringType(), False)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = encode(documents(spark, sf_dir).select("doc_id", "text"), round_trip=True)
    return r.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
