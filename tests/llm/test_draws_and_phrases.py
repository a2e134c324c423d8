"""Importance resampling, BPE with word ends and collocations against brute force, the library and SQL, with odd rows throughout."""

import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import collocations, importance, word_bpe

ODD = [None, "", " ", "\n\n", "a", "é", "x" * 5000, "aaaaaaa aaaa aa a", "the same words again " * 40, "漢字 and 😀 mixed spaces", "ΑΣ ΣΑΣ İstanbul ß ẞ", "\x1c!\x1d? a\x1eb", "é ́x", "don't WE'LL '''s ½ x²", "<|startoftext|>Hi<|endoftext|>é<|endoftext|>", "<|START tie.tie"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(80)] + ["w" * 70, "v" * 200]
    base = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 90))) for _ in range(120)]
    return ODD + base + base[:20] + ODD


def table(spark, rows):
    """Documents with further columns, some of them named as columns that the operators make."""
    return spark.createDataFrame([(*r, 1, "clash", b"x", 2) for r in rows], "doc_id long, text string, lang string, score int, phrase string, ids binary, part int")


def order(rows):
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("module", [importance, collocations])
def test_queries_against_sql(spark, con, module):
    df = module.query(spark, SF)
    rel = con.execute(module.SQL)
    assert [d[0] for d in rel.description] == df.columns
    assert order(map(tuple, df.collect())) == order(rel.fetchall())


def test_resampling(spark, texts):
    """Repeated ids and rows, null ids, ties and words over the bound of the tables."""
    rows = [(None if k % 29 == 0 else k // 2 if k % 3 else k, t, "en") for k, t in enumerate(texts)]
    target = [t for t in texts[40:60]] + [None, ""]
    got = importance.resample(table(spark, rows), table(spark, [(k, t, "en") for k, t in enumerate(target)])).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = importance.brute([r[:2] for r in rows], target)
    assert order(map(tuple, got)) == order(want)
    drawn = [r.rank for r in got if r.rank is not None]
    assert sorted(drawn) == list(range(1, len(drawn) + 1)) and len(drawn) > 20
    assert all(r.weight == 0 for r in got if not r.n_features)


def test_resampling_prefers_the_target(spark):
    """Of two kinds of text, three in four of the draw are of the target's kind."""
    rng = random.Random(3)
    kinds = [["law", "court", "judge", "claim", "party", "act"], ["goal", "match", "team", "ball", "coach", "score"]]
    rows = [(k, " ".join(rng.choice(kinds[k % 2]) for _ in range(40)), "en") for k in range(800)]
    got = importance.resample(table(spark, rows), table(spark, [(k, t, "en") for k, t, _ in rows[:40:2]])).where("rank is not null").collect()
    assert len(got) == 200 and sum(r.doc_id % 2 == 0 for r in got) > 150


def test_resampling_empty(spark):
    none, some = table(spark, []), table(spark, [(1, "a b c", "en")])
    assert importance.resample(none, some).collect() == []
    assert [r.rank for r in importance.resample(some, none).collect()] == [None]


def test_checksums():
    import zlib

    import pyarrow as pa

    from quillon.llm import textkit as tk
    from quillon.llm.decontaminate import ACCEPT, FOLD

    words = ["A", "bcd", "é漢", "x" * 63, "y" * 64, "Z" * 65, "q" * 1000, "b"]
    data, bounds = tk.buffers(pa.array([" ".join(words)]))
    w = tk.words(data, bounds, 0, 1, ACCEPT, FOLD)
    low = [x.lower() for x in words]
    for n, (at, bucket) in zip((1, 2, 3), importance.buckets(w, 3, 10_000), strict=True):
        assert at.tolist() == list(range(len(words) - n + 1))
        assert bucket.tolist() == [zlib.crc32(" ".join(low[k : k + n]).encode()) % 10_000 for k in range(len(words) - n + 1)]


def test_word_bpe_against_the_library(texts):
    lib = Tokenizer.from_file(public_tokenizers.path(word_bpe.VOCABULARY))
    v = word_bpe.Vocabulary(public_tokenizers.path(word_bpe.VOCABULARY))
    rng = random.Random(8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    more = ["".join(chr(rng.choice(points[:top])) for _ in range(30)) for top in (0x250, 0x3000, len(points)) for _ in range(400)]
    more += ["".join(rng.choice("aAb' stre1<|>́éΣ\n") for _ in range(40)) for _ in range(400)]
    every = [t or "" for t in texts] + more
    got = v.encode(every)
    want = [e.ids for e in lib.encode_batch(every, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want
    assert v.decode(got).to_pylist() == [lib.decode(x, skip_special_tokens=False) for x in want]
    strange = np.array([5, 10**6, 49407, 2**32 - 1, 300], "<u4")
    assert v.decode([strange.tobytes(), b""]).to_pylist() == [lib.decode([5, 49407, 300], skip_special_tokens=False), ""]


def test_word_bpe_merges_outrank_their_parts():
    """What joining a pair at all places in one round rests on."""
    import json

    with open(public_tokenizers.path(word_bpe.VOCABULARY), encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    made = {}
    for rank, (a, b) in enumerate(merges):
        assert made.get(a, -1) < rank and made.get(b, -1) < rank and a + b not in made
        made[a + b] = rank


def test_word_bpe_frames(spark, texts):
    """Both ways to decode agree, other columns stay, rows of null ids and long rows too."""
    rng = random.Random(4)
    long = " ".join("w%d" % rng.randint(0, 3000) for _ in range(250_000))
    rows = [(None if k % 31 == 0 else k, t, "en") for k, t in enumerate(texts)] + [(10_000, long, "en")]
    docs = table(spark, rows)
    enc = word_bpe.encode(docs)
    assert sorted(enc.columns) == sorted(docs.columns)
    two = {(r.doc_id, r.text): (bytes(r.ids), r.decoded) for r in word_bpe.decode(enc).collect()}
    one = [(r.doc_id, bytes(r.ids), r.decoded) for r in word_bpe.encode(docs, round_trip=True).collect()]
    assert order((d, *x) for (d, _), x in two.items()) == order(set(one)) and len(one) == len(rows)
    lib = Tokenizer.from_file(public_tokenizers.path(word_bpe.VOCABULARY))
    assert np.frombuffer(two[10_000, long][0], "<u4").tolist() == lib.encode(long, add_special_tokens=False).ids
    assert word_bpe.encode(docs.limit(0)).collect() == []


def test_word_bpe_contract(spark):
    lib = Tokenizer.from_file(public_tokenizers.path(word_bpe.VOCABULARY))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = word_bpe.query(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        want = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False).encode())]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *want)


@pytest.mark.parametrize("options", [{}, {"least": 5, "covered": 60, "best": 37}, {"least": 2, "longest": 3, "best": 10**6}])
def test_collocations(spark, options):
    """Nulls, ties, repeated rows and ids, pieces and words at every kind of border."""
    rng = random.Random(3)
    words = ["a", "B", "é", "c d", "The", "x.y", "z\t", "w\n", "q!", "", " k", "K"]
    docs = [(rng.choice(["en", "fr", None, "und", ""]), rng.choice([None, "", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(6)]])) for _ in range(150)]
    docs += [("en", "same words here again"), ("en", "same words here again. same words")] * 40
    df = table(spark, [(None if k % 7 == 0 else k % 50, t, lang) for k, (lang, t) in enumerate(docs)])
    got = collocations.collocations(df, shard_bytes=500, **options).collect()
    want = collocations.brute(docs, **options)
    assert order(map(tuple, got)) == order(want) and len(want) > 2
    assert collocations.collocations(df.limit(0)).collect() == []


def test_suffix_array():
    """Orders and shared words against sorting the suffixes themselves."""
    rng = np.random.default_rng(2)
    for n, depth in ((0, 4), (1, 4), (2, 4), (3, 4), (40, 4), (300, 4), (300, 3), (50, 1)):
        number, tie = rng.integers(1, 4, n), rng.random(n) < 0.8
        tie[n - 1 :] = False
        order_, shared = collocations.suffix_array(number, tie, depth)
        cut = [[int(number[i])] for i in range(n)]
        for i in range(n - 2, -1, -1):
            cut[i] += cut[i + 1] if tie[i] else []
        cut = [x[:depth] for x in cut]
        got = [cut[i] for i in order_]
        assert sorted(order_.tolist()) == list(range(n))
        for a, b, s in zip(got, got[1:], shared[1:].tolist(), strict=False):
            assert s == next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for m in range(1, depth + 1):
            first, width = collocations.intervals(order_, shared, tie, m)
            count = {}
            for x in cut:
                if len(x) >= m:
                    count[tuple(x[:m])] = count.get(tuple(x[:m]), 0) + 1
            assert {tuple(cut[i][:m]): w for i, w in zip(first.tolist(), width.tolist(), strict=True)} == count
