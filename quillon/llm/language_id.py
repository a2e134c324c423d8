"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language.  A text is parsed greedily into
phrases, each the longest piece that occurs in the labelled text; the language whose text
needs the fewest phrases per byte wins.  A phrase starts at the automaton's root, so the
parse is one table lookup a byte: a missing transition ends a phrase and starts the next.
Many pieces of texts are parsed in step with array operations.

The labelled sample is a bounded one: of each language at most SAMPLE_DOCS documents, chosen by a
hash of their ids, of each one piece of at most PIECE_CHARS characters from a place that the same
hash chooses, and of all pieces SAMPLE_BYTES bytes.  Every label is learned; with more than
TOTAL_BYTES / SAMPLE_BYTES labels each gets an equal share of TOTAL_BYTES, which bounds what is
broadcast (some 500 bytes of tables for a byte of sample).  Whole texts are parsed: they are cut into pieces of PIECE
bytes only to run side by side, which costs a phrase a piece in every language alike.

Defined cases: a null text or one without a letter is `und` with score 0; with nothing
labelled everything is `und`; ties go to the language with more labelled documents; repeated rows
and ids each give a row, rows without an id too; an empty table gives no rows; labels of any length
are labels; further columns, whatever their names, are ignored by `predict` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkit as tk
from quillon.llm.runtime import documents, short_batches, tidy

UND = "und"
SAMPLE_DOCS, SAMPLE_BYTES, PIECE_CHARS, TOTAL_BYTES = 200, 24_000, 500, 64 * 24_000
#: Phrases a byte, in texts of LEAST_BYTES or more, beyond which a text is in none of the learned languages.
MOST_PHRASES, LEAST_BYTES = 0.6, 32
PIECE, BATCH_BYTES = 1024, 8 << 20
SPACE = 0


def byte_classes() -> np.ndarray:
    """Letters fold to lower case, bytes of other characters stand for themselves, all else is one space."""
    out = np.full(256, SPACE, np.uint8)
    out[0x61:0x7B] = out[0x41:0x5B] = np.arange(1, 27)
    out[0x80:] = np.arange(27, 27 + 128)
    return out


CLASS = byte_classes()
N_CLASS = int(CLASS.max()) + 1


class Automaton:
    """Suffix automaton of one byte-class sequence, as a table of transitions with restarts."""

    def __init__(self, text: np.ndarray):
        step: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text.tolist():
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        used = np.unique(text)
        self.column = np.zeros(N_CLASS, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        # A missing transition ends the phrase (odd entries) and the byte starts the next one.  A byte that
        # the text doesn't have is a phrase of its own, after which, as at the front, every byte starts one.
        self.front = len(step) * self.width * 2
        restart = np.full(self.width, self.front + 1, np.int64)
        for c, to in step[0].items():
            restart[self.column[c]] = to * self.width * 2 + 1
        table = np.tile(restart, (len(step) + 1, 1))
        for s, edges in enumerate(step):
            for c, to in edges.items():
                table[s, self.column[c]] = to * self.width * 2
        self.table = table.reshape(-1).astype(np.int32)

    def phrases(self, pieces: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each piece; pieces: one a column, longest first, byte classes."""
        n = np.zeros(pieces.shape[1], np.int32)
        state = np.full(pieces.shape[1], self.front >> 1, np.int32)
        alive = np.searchsorted(-length, -np.arange(1, len(pieces) + 1), "right")
        for k in range(len(pieces)):
            m = alive[k]
            to = self.table[state[:m] + self.column[pieces[k, :m]]]
            n[:m] += to & 1
            state[:m] = to >> 1
        return n


@dataclass
class Model:
    names: list[str]
    automata: list[Automaton]

    def cost(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases per byte of each row (rows x languages)."""
        size = np.diff(bounds)
        many = -(-size // PIECE)
        owner = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
        start = bounds[owner] + nth * PIECE
        length = np.minimum(bounds[owner + 1] - start, PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        out = np.zeros((len(size), len(self.names)))
        if not len(owner):
            return out
        longest = int(length[0])
        classes = np.concatenate((CLASS[data], np.zeros(PIECE, np.uint8)))
        pieces = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(classes, longest)[start].T)
        for k, a in enumerate(self.automata):
            out[:, k] = np.bincount(owner, a.phrases(pieces, length), len(size))
        return out / np.maximum(size, 1)[:, None]


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from."""
    return docs.where((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Automata of a bounded sample of the labelled rows of each language."""
    rows = labelled(docs).select("lang", "doc_id", "text", F.xxhash64("doc_id", F.lit("sample")).alias("draw"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    count = {r[0]: r[1] for r in counts.collect()}
    if not count:
        return Model([], [])
    room_each = max(1, min(sample_bytes, TOTAL_BYTES // len(count)))
    # About half as many as may be, by the hash, and so a language of few documents gives all.
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in count.items() for x in (lang, min(1.0, sample_docs / 2 / n))]), F.col("lang"))
    start = F.pmod(F.col("draw"), F.greatest(F.lit(1), F.length("text") - PIECE_CHARS)).cast("int") + 1
    picked = rows.where(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < share).select("lang", "doc_id", F.substring(F.col("text"), start, F.lit(PIECE_CHARS)).alias("text"), "draw")
    texts: dict[str, list[tuple]] = {}
    for r in picked.toLocalIterator():
        texts.setdefault(r.lang, []).append((r.draw, r.text))
    names, automata = [], []
    for lang in [x for x in count if x in texts]:
        held, room = [], room_each
        for _, t in sorted(texts[lang])[:sample_docs]:
            raw = CLASS[np.frombuffer(t.encode()[:room], np.uint8)]
            raw = np.append(raw[np.append(True, (raw[1:] != SPACE) | (raw[:-1] != SPACE))] if len(raw) else raw, np.uint8(SPACE))
            held.append(raw)
            room -= len(raw)
            if room <= 0:
                break
        names.append(lang)
        automata.append(Automaton(np.concatenate(held)))
    return Model(names, automata)


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the share of the runner-up's phrases in both, from 1/2 for a tie to 1) and phrases, the winner's a byte."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @tidy("language_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, lang, score, phrases in judged(held.value, batch.column(1), batch.column(2)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lang, pa.array(score), pa.array(phrases)], names=["doc_id", "lang_pred", "score", "phrases"])

    return short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", lettered(F.col("text")).alias("good")).mapInArrow(run, "doc_id long, lang_pred string, score double, phrases double")


def judged(m: Model, texts: pa.Array, good: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """Row range, language, score and phrases a byte of the texts, some at a time.  good: which have a letter."""
    names = np.array([*m.names, UND], object)
    data, bounds = tk.buffers(texts)
    good = good.to_numpy(zero_copy_only=False).astype(bool)
    for lo, hi in tk.slices(bounds, BATCH_BYTES):
        best = np.full(hi - lo, len(m.names))
        score, phrases = np.zeros(hi - lo), np.zeros(hi - lo)
        if m.names:
            cost = m.cost(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
            best = np.where(good[lo:hi], cost.argmin(axis=1), best)
            two = np.sort(np.column_stack((cost, np.full(hi - lo, np.inf))), axis=1)[:, :2]
            both = two[:, 0] + two[:, 1]
            score = np.where(good[lo:hi], np.where(np.isinf(both), 1.0, two[:, 1] / np.where(both > 0, both, 1)), 0.0)
            phrases = two[:, 0]
        yield lo, hi, pa.array(names[best], pa.string()), score, phrases


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are in a learned language, with all columns; where `lang` is null it is the predicted one.

    Rejected are texts without a letter, and texts whose best parse needs more than MOST_PHRASES phrases
    a byte: nothing was learned of what they are written in.  The rows are judged where they are read.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs))
    flag = next(f"_good{k}" for k in range(len(docs.columns) + 1) if f"_good{k}" not in docs.columns)
    names = docs.columns
    at, lang = names.index("text"), names.index("lang")

    @tidy("language_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(tk.buffers(batch.column(at))[1])
            for lo, hi, name, _, phrases in judged(held.value, batch.column(at), batch.column(batch.num_columns - 1)):
                keep = (name.to_numpy(zero_copy_only=False) != UND) & ((phrases <= MOST_PHRASES) | (size[lo:hi] < LEAST_BYTES))
                part = batch.slice(lo, hi - lo)
                columns = part.columns[:-1]
                columns[lang] = pc.coalesce(columns[lang], name.cast(columns[lang].type))
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return short_batches(docs).withColumn(flag, lettered(F.col("text"))).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return predict(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "phrases")
