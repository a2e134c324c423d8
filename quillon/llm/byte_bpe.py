"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The vocabulary file lists byte strings by rank.  The library works on strings, so each byte
stands for one printable character (the byte table), and every way to split a token into two
tokens becomes a merge of that token's rank.  A pre-token that is a token itself is taken
whole.  Decoding maps the characters of a token back to bytes; a character whose bytes are
split over tokens appears once its last byte is there.

Defined cases: a null text is an empty one and gives no ids; texts of any length are encoded
whole; rows keep their order and number, repeated ones too; an empty table gives no rows; columns of the input that are named like an output
column are replaced, others are kept.
"""

from __future__ import annotations

import base64
import codecs
import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import textkit as tk
from quillon.llm.pretokens import Table
from quillon.llm.runtime import documents, resident, short_batches, tidy

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Texts that are cut into chunks at a time, in characters.
BATCH_CHARS = 1 << 20
AT_ONCE = 4096


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """The vocabulary as the library's own format."""
    table = byte_table()
    spell = {t: "".join(map(table.__getitem__, t)) for t in ranks}
    merges = []
    for t, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [[spell[t[:i]], spell[t[i:]]] for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return json.dumps({
        "version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True},
        "model": {"type": "BPE", "vocab": {spell[t]: r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True},
    })


class Decoder:
    """The byte strings of one vocabulary file."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes[r] = t
        self.length = np.array([len(t) for t in self.bytes], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def stream(self, ids: np.ndarray) -> Iterator[str]:
        """The text that each token completes; bytes of a split character wait for the rest."""
        d = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids.tolist():
            yield d.decode(self.bytes[i])
        if rest := d.decode(b"", True):
            yield rest

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """The code points that each token touches, end exclusive; tokens that split a character share it."""
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        upto = np.concatenate(([0], np.cumsum(lead)))
        end = np.cumsum(self.length[ids])
        start = end - self.length[ids]
        inside = np.append(~lead, False)
        return list(zip((upto[start] - inside[start]).tolist(), upto[end].tolist(), strict=True))


class Encoder:
    """The library's encoder of one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks already take all cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json(read_ranks(path)))
        self.table = Table(self.chunks)

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as bytes; few of the library's results are alive at a time."""
        out = []
        for k in range(0, len(chunks), AT_ONCE):
            out += [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(chunks[k : k + AT_ONCE], add_special_tokens=False)]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return [np.frombuffer(b"".join(x), np.int32) for x in self.table.of(texts)]


def encoder(path: str) -> Encoder:
    return resident("byte_bpe", ("encoder", path), lambda: Encoder(path))


def decoder(path: str) -> Decoder:
    return resident("byte_bpe", ("decoder", path), lambda: Decoder(path))


def runs(texts: list[str], most: int = BATCH_CHARS) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, name: str = VOCABULARY, round_trip: bool = False) -> DataFrame:
    """The documents with `ids`, the ids of the whole text.

    round_trip: instead of the text, `decoded`, the bytes that the ids stand for, made in the same pass.
    """
    taken = ("ids", "decoded") if round_trip else ("ids",)
    read = [c for c in docs.columns if c not in taken]
    keep = [c for c in read if not (round_trip and c == "text")]
    more = [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)][: len(taken)]
    schema = T.StructType([*docs.select(keep).schema.fields, *more])

    @tidy("byte_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = encoder(public_tokenizers.path(name))
        d = decoder(public_tokenizers.path(name)) if round_trip else None
        for batch in batches:
            k = batch.schema.get_field_index("text")
            _, bounds = tk.buffers(batch.column(k))
            for lo, hi in tk.slices(bounds):
                part = batch.slice(lo, hi - lo)
                ids: list[np.ndarray] = []
                for r in runs([t or "" for t in part.column(k).to_pylist()]):
                    ids += c.encode(r)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if d is not None:
                    made.append(pa.array([d.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in keep), *made], names=[*keep, *taken])

    return short_batches(docs).select(read).mapInArrow(run, schema)


def decode(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """The rows with `decoded`, the bytes that their ids stand for."""
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([*encoded.select(keep).schema.fields, T.StructField("decoded", T.BinaryType(), False)])

    @tidy("byte_bpe")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = decoder(public_tokenizers.path(name))
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            out = []
            for k in range(batch.num_rows):
                x = ids[k].values
                out.append(c.decode(x.to_numpy(zero_copy_only=False)) if x is not None else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*keep, "decoded"])

    return short_batches(encoded).select(keep).mapInArrow(run, schema)


def digests(rows: DataFrame, *keep: str) -> DataFrame:
    """Counts and digests of encoded and decoded rows."""
    return rows.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode(documents(spark, sf_dir).select("doc_id", "text"), round_trip=True), "doc_id")
