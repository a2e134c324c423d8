"""The ten operators against brute force, round trips, libraries and held-out accuracy, with odd rows throughout."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import byte_bpe, chat_format, decontaminate, html_extract, language_id, media_audio, near_dedup, secret_scan, substring_dedup, token_count

ODD = [None, "", " ", "\n\n", "a", "é", "x" * 5000, "the same words again " * 40, "漢字 and 😀 mixed spaces", "</s>[INST]", "tie tie tie tie tie"]


def table(spark, texts, first=0):
    """Rows of documents with further columns whose names clash with those of operators."""
    rows = [(first + k, t, "en", "src", None if t is None else len(t), "clash", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, spans int")


def prose(rng, n, words=60):
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(words)]
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 150), 400) for _ in range(30)]
    passage = prose(rng, 70, 400)
    out = ODD + base + base[:5] + base[:2] + [base[k] + " " + passage for k in range(6, 10)] + [passage + "\n" + base[11]]
    return out + ODD


def test_secrets(spark, texts):
    rows = texts + ['my Password = "hunter22x" and token:ab token=token: abcdefgh', "AKIA" + "A" * 16 + " AKIA" + "B" * 15, "deadbeef" * 3 + " " + "ab" * 11, "é token=x1y2z3w4 " * 30, "key xq8Zt3LpW0vN5rYk2QmJ7c9Xb4 end"]
    model = secret_scan.train(secret_scan.samples(spark, 2000))
    got = secret_scan.scan(table(spark, rows), model).select("doc_id", secret_scan.spell(F.col("base_spans")).alias("base"), secret_scan.spell(F.col("spans")).alias("all")).collect()
    for r in got:
        want = [f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in secret_scan.brute(rows[r["doc_id"]])]
        assert r["base"] == ",".join(want)
        assert set(want) <= set(r["all"].split(","))
    last = next(r for r in got if r["doc_id"] == len(rows) - 1)
    assert last["all"] == "random:4:30"
    red = {r.doc_id: r for r in secret_scan.redact(table(spark, rows), model).collect()}
    assert red[len(rows) - 1].text == "key <secret> end" and red[len(rows) - 1].n_chars == 16
    assert red[0].text is None and red[4].text == "a"


def test_redact_keeps_columns_of_any_name(spark):
    """Columns named like the operator's own, and names that need quoting, come back with the user's values."""
    rows = [(1, 'password = "hunter22x"', "a", "b", "c", "d", "e", "f", 22), (None, None, "a", "b", "c", "d", "e", "f", None), (3, "plain", "a", "b", "c", "d", "e", "f", 5)]
    names = ["doc_id", "text", "spans", "base_spans", "_new", "_tokens", "_row", "odd.name", "n_chars"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, base_spans string, _new string, _tokens string, _row string, `odd.name` string, n_chars long")
    got = secret_scan.redact(docs)
    assert got.columns == names
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1]["text"] == '<secret>"' and by[1]["n_chars"] == 9 and by[None]["text"] is None and by[3]["text"] == "plain"
    assert all([r[c] for c in names[2:8]] == list("abcdef") for r in by.values())
    assert secret_scan.redact(docs.limit(0)).collect() == []


def test_secret_model_parts_random_from_ordinary(spark):
    model = secret_scan.train(secret_scan.samples(spark, 2000))
    fresh = secret_scan.samples(spark, 6000).withColumn("k", F.monotonically_increasing_id()).where("length(token) >= 20")
    got = fresh.select("secret", (secret_scan.ratio(F.col("token"), model) > secret_scan.THRESHOLD).alias("said")).groupBy("secret").agg(F.avg(F.col("said").cast("int")).alias("share")).collect()
    share = {r.secret: r.share for r in got}
    assert share[True] > 0.98 and share[False] < 0.02


@pytest.mark.parametrize("window,gram", [(50, 10), (6, 3)])
def test_substring_dedup(spark, texts, window, gram):
    got = substring_dedup.repeats(table(spark, texts), window, gram, bucket_bytes=4000).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(substring_dedup.brute(list(enumerate(texts)), window))


def test_substring_dedup_small_sketch(spark, texts, monkeypatch):
    """A sketch that is far too small estimates too much and still loses nothing."""
    monkeypatch.setattr(substring_dedup, "sizes", lambda docs, a, b: (12, 5))
    got = substring_dedup.repeats(table(spark, texts), 6, 3).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(substring_dedup.brute(list(enumerate(texts)), 6))


def test_media(spark, texts):
    media = media_audio.attach(table(spark, texts))
    got = {r.doc_id: r for r in media_audio.index(media).collect()}
    for k, t in enumerate(texts):
        n, size, digest, _ = media_audio.brute(t)
        r = got[k]
        assert (r.n_bytes, len(r.payload), hashlib.sha256(r.payload).hexdigest()) == (n, size, digest)
        assert r.samples == size and r.hertz == 16000 and r.vbr and len(r.offsets) == r.frames and r.skipped == 0
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"\xff\xfb junk" * 50))], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media_audio.index(odd).collect()}
    assert rows[1].frames is None and rows[2].frames == 0 and rows[3].frames == 0


def test_media_resynchronises():
    b = media_audio.store(b"some words " * 500)
    whole = media_audio.parse(b)
    cut = whole.offsets[3]
    torn = b[:cut] + b"\xff\xf2 noise \xff" + b[cut:]
    s = media_audio.parse(torn)
    assert s.frames == whole.frames and s.skipped == len(torn) - len(b) and media_audio.load(torn, s)[0] == media_audio.load(b)[0]
    bad = bytearray(b)
    bad[cut + 5] ^= 1
    s = media_audio.parse(bytes(bad))
    assert s.bad_checksums == 1 and s.frames == whole.frames - 1
    assert whole.table_frames == whole.frames and len(whole.table_seek) == 100 and whole.tags["n_bytes"] == "5500"
    # A plain frame of another kind: MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, no checksum.
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    s = media_audio.parse(frame * 10)
    assert (s.frames, s.samples, s.hertz) == (10, 11520, 44100)


def bitwise_crc(bits):
    r = [1] * 16
    for b in bits:
        out = r[0] ^ b
        r = r[1:] + [0]
        if out:
            for k in (0, 13, 15):
                r[k] ^= 1
    return int("".join(map(str, r)), 2)


def bits_of(data):
    return [int(b) for x in data for b in f"{x:08b}"]


@pytest.mark.parametrize(
    ("head", "length", "body", "bits"),
    [
        # Layer II, 192 kbit/s, 48 kHz, two channels: 2 x 88 bits of allocations, then 2 for each that isn't zero.
        (b"\xff\xfc\xa4\x00", 576, bytes([0x50, 0x01]) + bytes(30), 176 + 2 * 2),
        # The same as joint stereo from subband 4 on: 32 bits twice over, the other 72 once for both channels.
        (b"\xff\xfc\xa4\x40", 576, bytes([0x11, 0, 0, 0, 0x10]) + bytes(30), 32 + 72 + 2 * 2 + 2 * 2),
        # One channel at 48 kbit/s, 32 kHz: 2 x 4 and 10 x 3 bits.
        (b"\xff\xfc\x28\xc0", 216, bytes([0xF0]) + bytes(30), 38 + 2),
        # MPEG-2, 160 kbit/s, 24 kHz, two channels: 2 x 75 bits.
        (b"\xff\xf4\xe4\x00", 960, bytes(40), 150),
        # Layer I, 192 kbit/s, 48 kHz: joint stereo from subband 8 on, two channels, one channel.
        (b"\xff\xfe\x64\x50", 192, bytes(range(40)), 160),
        (b"\xff\xfe\x64\x00", 192, bytes(range(40)), 256),
        (b"\xff\xfe\x64\xc0", 192, bytes(range(40)), 128),
    ],
)
def test_checksums_of_layers_1_and_2(head, length, body, bits):
    want = bitwise_crc(bits_of(head[2:4]) + bits_of(body)[:bits])
    frame = head + want.to_bytes(2, "big") + body
    frame += bytes(length - len(frame))
    s = media_audio.parse(frame * 6)
    assert (s.frames, s.bad_checksums, s.skipped, s.offsets) == (6, 0, 0, list(range(0, 6 * length, length)))
    torn = bytearray(frame * 6)
    torn[2 * length + 6 + (bits - 1) // 8] ^= 128 >> (bits - 1) % 8
    s = media_audio.parse(bytes(torn))
    assert (s.frames, s.bad_checksums) == (5, 1)
    torn = bytearray(frame * 6)
    torn[2 * length + 6 + bits // 8] ^= 128 >> bits % 8  # the first bit that isn't covered
    assert media_audio.parse(bytes(torn)).frames == 6


def test_tables_and_tags_of_other_encoders(spark):
    head = b"\xff\xfb\x90\x00"  # MPEG-1 Layer III, 128 kbit/s, 44.1 kHz, two channels
    plain = head + bytes(413)
    vbri = head + bytes(32) + b"VBRI" + b"".join(x.to_bytes(n, "big") for x, n in ((1, 2), (576, 2), (75, 2), (4170, 4), (9, 4), (3, 2), (10, 2), (2, 2), (3, 2), (125, 2), (126, 2), (127, 2)))
    lame = head + bytes(32) + b"Info" + (15).to_bytes(4, "big") + (9).to_bytes(4, "big") + (4170).to_bytes(4, "big") + bytes(range(100)) + bytes(4) + b"LAME3.100" + bytes(12) + (576 << 12 | 1000).to_bytes(3, "big")

    def field3(name, body):
        return name + len(body).to_bytes(4, "big") + b"\0\0" + body

    def tag(version, flags, body):
        return b"ID3" + bytes([version, 0, flags, *((len(body) >> k) & 127 for k in (21, 14, 7, 0))]) + body

    old = b"TAG" + b"an old title".ljust(30, b"\0") + b"someone".ljust(30, b" ") + bytes(30) + b"1999" + bytes(28) + bytes([0, 7, 1])
    third = tag(3, 0, field3(b"TIT2", b"\1" + "título".encode("utf-16")) + field3(b"TXXX", b"\1" + "clé".encode("utf-16") + b"\0\0" + "été".encode("utf-16")) + field3(b"APIC", b"\0\0\0"))
    fourth = tag(4, 0x40, (6).to_bytes(4, "big") + b"\1\0" + b"TPE1" + bytes([0, 0, 0, 5]) + b"\0\0" + b"\3a\0bc" + b"TCON" + bytes([0, 0, 0, 3]) + b"\0\x08" + b"\3zz")
    second = tag(2, 0, b"TT2" + (4).to_bytes(3, "big") + b"\0two" + bytes(20))
    fill = lambda x: x.ljust(417, b"\0")
    s = media_audio.parse(third + fill(vbri) + plain * 9 + old)
    assert (s.table, s.table_frames, s.table_bytes, s.table_seek, s.delay) == ("VBRI", 9, 4170, [0, 1250, 2510], 576)
    assert (s.frames, s.samples, s.skipped) == (9, 9 * 1152, 0)
    assert s.tags == {"TIT2": "título", "clé": "été", "TPE1": "someone", "TYER": "1999", "TRCK": "7"}
    s = media_audio.parse(fourth + fill(lame) + plain * 9)
    assert (s.table, s.table_seek, s.delay, s.padding, s.frames, s.tags) == ("Info", list(range(100)), 576, 1000, 9, {"TPE1": "a/bc"})
    assert media_audio.parse(second + plain * 3).tags == {"TIT2": "two"}
    wild = tag(3, 0, field3(b"TXXX", b"\0n_bytes\0many")) + fill(vbri[:46] + b"\xff" * 200) + plain * 3
    rows = [(1, bytearray(wild)), (1, bytearray(wild)), (None, bytearray(third[:30])), (2, bytearray(b"ID3")), (3, bytearray(old))]
    got = media_audio.index(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("frames", F.lit("clash"))).collect()
    assert [r.frames for r in got] == [3, 3, 0, 0, 0] and got[0].vbr and got[0].seek == []


def test_language(spark):
    rng = random.Random(3)
    kinds = {"aa": ["kalo", "miru", "tenshi", "no", "wa"], "bb": ["der", "schung", "ver", "keit", "und"], "cc": ["ción", "los", "que", "ando", "ñar"]}
    rows = []
    for k in range(240):
        lang = rng.choice(sorted(kinds))
        rows.append((k, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang, "x"))
    rows += [(1000 + k, t, None if k % 2 else "aa", "x") for k, t in enumerate([None, "", "123 456", "!!", "9" * 9000])] + [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.predict(docs, language_id.train(docs)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    import zlib

    held = [r for r in got if r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id >= 1000)
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.clean(docs).count() == 242
    assert {r.lang_pred for r in language_id.predict(docs, language_id.Model([], [])).collect()} == {"und"}


def test_automaton_finds_longest_matches():
    rng = random.Random(1)
    import numpy as np

    text = np.array([rng.randint(1, 3) for _ in range(300)], np.uint8)
    a = language_id.Automaton(text)
    hay = bytes(text)
    for _ in range(50):
        piece = bytes(rng.randint(1, 4) for _ in range(rng.randint(1, 40)))
        n, at = 0, 0
        while at < len(piece):
            k = 1
            while at + k < len(piece) and piece[at : at + k + 1] in hay:
                k += 1
            n, at = n + 1, at + k
        got = a.phrases(np.frombuffer(piece, np.uint8)[:, None], np.array([len(piece)]))[0]
        assert got == n


def test_decontamination(spark, texts):
    items = [(str(k), t) for k, t in enumerate([None, "", "tie", "the same words", texts[len(ODD)], texts[-1], " ".join((texts[-len(ODD) - 1] or "").split()[5:20]), "Same WORDS-again"])]
    bench = spark.createDataFrame([(int(k), t, 1) for k, t in items], "item_id long, text string, doc_id int")
    want = sorted(decontaminate.brute(list(enumerate(texts)), items))
    for size in (decontaminate.BLOCK_BYTES, 200):
        h = decontaminate.hits(table(spark, texts), bench, size)
        got = h.select("doc_id", "n_words", F.size("hit_words"), F.size("items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256), F.size("hit_words") > 0).collect()
        assert sorted(map(tuple, got)) == want
    kept = {r.doc_id for r in decontaminate.clean(table(spark, texts), bench).collect()}
    assert kept == {r[0] for r in want if not r[5]}


def test_decontamination_repeated_ids(spark):
    """Repeated rows, and rows of one id with different texts, give a row each whatever the number of blocks."""
    items = [(k, f"item {k} has its own words") for k in range(20)] + [(1, "item 2 has its own words")]
    rows = [(1, items[0][1]), (1, items[0][1]), (1, f"{items[1][1]} {items[2][1]}"), (2, "clean"), (2, None), (2, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted((r.doc_id, r.n_words, tuple(r.hit_words), tuple(sorted(r["items"]))) for r in decontaminate.hits(docs, bench, size).collect()) for size in (decontaminate.BLOCK_BYTES, 200)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    assert all(len(r[3]) == len(set(r[3])) for r in got[0])


def fuzz():
    rng = random.Random(2)
    pool = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "23", "'s", "'ll", "!", "...", "\xa0", " ", "\x1c", "\x85", "漢字", "😀", "aaaa", "<|endoftext|>", "\r\n", "the", "ING", "\x00"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["a" * n for n in range(40)] + [" " * n + "x" for n in range(20)]


def test_byte_bpe(spark, texts):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = texts + fuzz()
    got = byte_bpe.decode(byte_bpe.encode(table(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == lib.encode_ordinary(rows[r.doc_id] or "") and bytes(r.decoded).decode() == (rows[r.doc_id] or "")
    both = byte_bpe.encode(table(spark, rows), round_trip=True)
    assert "text" not in both.columns and {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in both.collect()} == {(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got}
    d = byte_bpe.decoder(path)
    import numpy as np

    ids = np.array(lib.encode_ordinary("é漢😀"), np.int32)
    assert "".join(d.stream(ids)) == "é漢😀" and "".join(d.stream(ids[:-1])).endswith("�")
    assert d.offsets("é漢😀", ids)[0][0] == 0 and d.offsets("é漢😀", ids)[-1][1] == 3


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(token_count.VOCABULARY))
    rows = texts + fuzz()
    got = token_count.count_tokens(table(spark, rows)).collect()
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in rows]
    assert [r.n_tokens for r in sorted(got)] == want
    assert [r.n_bytes for r in sorted(got)] == [len((t or "").encode()) for t in rows]


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a </s> & < [INST] b"), (1, 1, "assistant", "&amp;lt;"), (1, 1, "assistant", "&amp;lt;"), (2, 0, None, None), (2, 3, "assistant", "x[/INST]"), (2, 1, "we[i]rd", "")]
    shown = chat_format.render(chat_format.canonical(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.conv_id: r for r in shown.select("conv_id", "turns", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.learned(F.col("formatted"), F.col("loss")).alias("learn")).collect()}
    assert all(r.turns == r.back for r in got.values())
    assert got[1].learn == "&amp;lt;" * 2 and got[2].learn == "x[/INST]" and [t.role for t in got[2].back] == ["", "we[i]rd", "assistant"]


def test_chat_layouts(spark):
    import json

    rows = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "n": 1}], "extra": 1}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "response": "a"}, {"other": 1}, {}]
    df = spark.createDataFrame([(json.dumps(x),) for x in rows] + [(None,), ("no json",)], "j string")
    got = [r.turns for r in chat_format.canonical_json(df, "j").collect()]
    assert all([tuple(t) for t in g] == [("user", "q"), ("assistant", "a")] for g in got[:4]) and got[4:] == [None] * 4
    typed = spark.createDataFrame([("q", "a", 7)], "prompt string, completion string, other int")
    assert [tuple(t) for t in chat_format.canonical(typed).first().turns] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat_format.canonical(spark.createDataFrame([(1,)], "n int"))


def edited(rng, words, n, mark):
    x = list(words)
    for at in rng.sample(range(len(x)), n):
        x[at] = f"edit{mark}x{at}"
    return " ".join(x)


def plain_classes(rows):
    """Classes by five-word shingles and plain Jaccard similarity, with Python sets."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [shingles(t) for t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if root(a) != root(b) and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in range(len(rows))}


def class_of(spark, rows):
    return {r.doc_id: r.class_id for r in near_dedup.classes(table(spark, rows)).collect()}


def test_near_dedup(spark, texts):
    rng = random.Random(9)
    rows = list(texts)
    for _ in range(4):
        b = prose(rng, 200, 2000).split()
        rows += [" ".join(b)] + [edited(rng, b, 3, f"{len(rows)}y{k}") for k in range(6)]
    want = near_dedup.brute(rows)
    plain = plain_classes(rows)
    assert all(want[k] == want[plain[k]] for k in plain)
    assert class_of(spark, rows) == dict(enumerate(want))
    kept = near_dedup.clean(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == set(want)


def test_near_dedup_star(spark):
    """Copies that are alike only through their original, whose id is neither the least nor the greatest."""
    rng = random.Random(17)
    original = ["w%d" % rng.randrange(10**6) for _ in range(200)]
    rows = []
    for k in range(101):
        x = list(original)
        for at in rng.sample(range(5, 195, 5), 4) if k != 50 else ():
            x[at] = "edit%d" % (1000 * k + at)
        rows.append(" ".join(x))
    plain = plain_classes(rows)
    assert set(plain.values()) == {0} and len(set(plain_classes(rows[:50]).values())) == 50
    assert set(class_of(spark, rows).values()) == {0}


def test_near_dedup_fringe(spark):
    """A hot group of copies, and copies of single copies that only those reach."""
    rng = random.Random(23)
    original = ["w%d" % rng.randrange(10**6) for _ in range(400)]
    group = [edited(rng, original, 3, f"a{k}") for k in range(300)]
    fringe = [edited(rng, group[rng.randrange(300)].split(), 6, f"b{k}") for k in range(20)]
    rows = [original and " ".join(original), *group, *fringe]
    assert set(class_of(spark, rows).values()) == {0}


def test_near_dedup_family_under_the_threshold(spark, monkeypatch):
    """Texts of one template that are under 0.8 to each other stay apart; two that are over it meet, in a bucket of several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 60)
    rng = random.Random(29)
    template = ["t%d" % k for k in range(300)]
    rows = [edited(rng, template, 10, f"c{k}") for k in range(150)]
    rows += [edited(rng, rows[k].split(), 2, f"d{k}") for k in (3, 70, 149)]
    got, plain = class_of(spark, rows), plain_classes(rows)
    assert got[150] == 3 and got[151] == 70 and got[152] == 149 and all(got[k] == got[plain[k]] for k in plain)
    assert got == dict(enumerate(near_dedup.brute(rows)))


def test_near_dedup_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    want = near_dedup.brute([r.text for r in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == {r.doc_id: rows[c].doc_id for r, c in zip(rows, want, strict=True)}


def test_near_dedup_odd_ids(spark):
    """No id, one id with several texts, one id with one text twice."""
    rng = random.Random(31)
    a, b, c = (prose(rng, 100, 3000) for _ in range(3))
    rows = [(None, a), (None, None), (1, a), (2, b), (2, a), (3, b), (4, c), (4, c), (5, None)]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {None: None, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert near_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).count() == 6


def test_weighted_sampling_agrees_with_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    ids = rng.integers(1, 1 << 47, 3000).astype(np.uint64)
    hits, want = 0, []
    for k in range(300):
        pick = rng.random(len(ids)) < 0.05
        a = np.sort(ids[pick | (rng.random(len(ids)) < 0.01)])
        b = np.sort(ids[pick | (rng.random(len(ids)) < 0.01)])
        wa, wb = np.full(len(a), 1.0) + (a % 3 == 0), np.full(len(b), 1.0) + (b % 3 == 0)
        want.append(near_dedup.similarity((a, wa), (b, wb)))
        sa = near_dedup.sample(a, np.log(wa).astype(np.float32), np.array([0, len(a)]))[0]
        sb = near_dedup.sample(b, np.log(wb).astype(np.float32), np.array([0, len(b)]))[0]
        hits += int((sa == sb).sum())
    assert abs(hits / (300 * near_dedup.SAMPLES) - np.mean(want)) < 0.02


def test_empty_tables(spark):
    docs = table(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert secret_scan.scan(docs).count() == 0
    assert substring_dedup.repeats(docs).count() == 0
    assert media_audio.index(media_audio.attach(docs)).count() == 0
    assert language_id.clean(docs).count() == 0
    assert decontaminate.clean(docs, bench).count() == 0
    assert decontaminate.hits(table(spark, ["a b"]), bench).first().n_words == 2
    assert byte_bpe.encode(docs).count() == 0
    assert token_count.count_tokens(docs).count() == 0
    assert near_dedup.classes(docs).count() == 0
    assert chat_format.canonical(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html_extract.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def page(menu, body, host="a.example.com", k=0):
    return (k, f"https://{host}/p/{k}?x=1", f"<html><head><title>t</title></head><body><div id=top><a href=/>{menu}</a></div>{body}<div id=bottom>All rights reserved.</div></body></html>")


def test_html(spark):
    rng = random.Random(4)
    rows = [page("Home", f"<div id=c><h2>{prose(rng, 4)}</h2><p>{prose(rng, 60)} &amp; x<p>{prose(rng, 60)}<ul><li>one {k}<li>two {k}</ul></div><div class='comments'><p>{prose(rng, 50)}</div>", k=k) for k in range(6)]
    rows += [(10, None, "<article><h1>T&eacute;</h1><p>a\n b<br>c<p><b>d</article><footer>f"), (11, "x", None), (12, "", ""), (13, "http://b.example.com/", "plain text"), (14, "http://b.example.com/2", "<p>unclosed <b>bold <!-- c --> <script>var a='<p>'</script>end"), (14, "http://b.example.com/2", "<div hidden>no</div><nav>n</nav><main><p>yes</p><form>f</form></main>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {}
    for r in html_extract.main_text(df.withColumn("text", F.lit("clash")).withColumn("wrapper", F.lit(1))).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for k in range(6):
        lines = got[k][0].split("\n")
        assert len(lines) == 5 and lines[1].endswith("& x") and lines[3:] == [f"one {k}", f"two {k}"]
    assert got[10] == ["Té\na b c\nd"] and got[11] == [""] and got[12] == [""] and got[13] == ["plain text"]
    assert sorted(got[14]) == ["unclosed bold end", "yes"]


def test_html_many_layouts(spark):
    """A layout that comes after pages of ever new classes, and pages with their number in body's class."""
    rng = random.Random(6)
    rows = [page("New", "".join(f"<div class=x{k}y{n}><p class=z{k}y{n}>{prose(rng, 3)}</p></div>" for n in range(40)), k=k) for k in range(30)]
    rows = [(k, url, html.replace("<body>", f"<body class=slug-{chr(97 + k)}>")) for k, url, html in rows]
    rows += [page("Home", f"<section><p>{prose(rng, 60)}</p></section><table><tr><td>{prose(rng, 60)}</td></tr></table>", k=k) for k in range(30, 36)]
    numbered = [page("Home", f"<section><p>{prose(rng, 60)}</p></section><table><tr><td>{prose(rng, 60)}</td></tr></table>", host="n.example.com", k=k) for k in range(40, 46)]
    rows += [(k, url, html.replace("<body>", f"<body class=postid-{k}>")) for k, url, html in numbered]
    got = {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert all("Home" not in got[k] and "reserved" not in got[k] and len(got[k]) > 100 for k in [*range(30, 36), *range(40, 46)])


def test_tree_matching():
    S = html_extract.Slot
    a = S("div", children=[S("p"), S("ul", children=[S("li")]), S("p")])
    b = S("div", children=[S("ul", children=[S("li")]), S("p")])
    assert html_extract.size(a, b, {}) == 4
    assert html_extract.matching(a.children, b.children, {}) == [(1, 0), (2, 1)]


def main_texts(spark, rows):
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_wrapper_decides(spark):
    """Without names to go by, constant text goes and varying text stays; without the wrapper all of it stays."""
    rng = random.Random(8)
    body = {k: [prose(rng, 5), prose(rng, 30), prose(rng, 60)] for k in range(12)}
    rows = [(k, f"http://w.example.com/{k}", f"<body><div>Welcome to the site</div><h1>{b[0]}</h1><p>{b[1]}</p><div>{b[2]}</div><section>Imprint of the house</section></body>") for k, b in body.items()]
    got = main_texts(spark, rows)
    assert got == {k: "\n".join(b) for k, b in body.items()}
    assert all(html_extract.extract(h).split("\n") == ["Welcome to the site", *body[k], "Imprint of the house"] for k, _, h in rows)
    article = [(k, u, h.replace("<body>", "<body><article>").replace("</body>", "</article></body>")) for k, u, h in rows]
    assert main_texts(spark, article) == got
    few = main_texts(spark, article[:5])  # too few pages to be sure inside an article
    assert all("Welcome" in few[k] for k in range(5))
    same = main_texts(spark, [(k, u, article[0][2]) for k, u, _ in article])  # one article on many pages is no template
    assert all(t == html_extract.extract(article[0][2]) for t in same.values())


def test_html_odd_markup():
    import time

    began = time.perf_counter()
    for x in ("<a" * 100_000, "<a b " * 50_000, '<a "' * 50_000, "<!" * 50_000, "<!--" * 50_000, "<p>" * 20_000, "<div>" * 20_000 + "deep" + "</div>" * 20_000):
        html_extract.extract(x)
    assert time.perf_counter() - began < 20
    deep = "<article>" + "<div>" * 300 + "in" + "</div>" * 300 + "<p>after</p></article><p>out</p>"
    assert html_extract.extract(deep).split("\n") == ["in", "after"]
    assert html_extract.extract("<body><h1>title</h1><p>intro</p><div>" + "long body " * 50 + "</div></body>").startswith("title\nintro\nlong body")


def test_tree_matching_against_brute_force():
    """Largest number of matched nodes, by trying every way to pair children in order."""
    import itertools

    rng = random.Random(12)
    S = html_extract.Slot

    def grow(depth):
        return S(rng.choice("ab"), children=[grow(depth - 1) for _ in range(rng.randint(0, 3 if depth else 0))])

    def best(a, b):
        if a.shape != b.shape:
            return 0
        most = 0
        for n in range(min(len(a.children), len(b.children)) + 1):
            for x in itertools.combinations(a.children, n):
                for y in itertools.combinations(b.children, n):
                    if all(p.shape == q.shape for p, q in zip(x, y, strict=True)):
                        most = max(most, sum(best(p, q) for p, q in zip(x, y, strict=True)))
        return most + 1

    for _ in range(60):
        a, b = grow(2), grow(2)
        a.shape = b.shape = "root"
        got = html_extract.size(a, b, {})
        same = len(a.children) == len(b.children) and all(x.shape == y.shape for x, y in zip(a.children, b.children, strict=True))
        assert got <= best(a, b) and (same or got == best(a, b) or any(x.children for x in a.children))


def test_hashes_of_long_words():
    """Two Thue-Morse words, which polynomial hashes modulo 2**64 can't part, are two words."""
    import numpy as np
    import pyarrow as pa

    from quillon.llm import textkit as tk

    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    data, bounds = tk.buffers(pa.array([a, b]))
    w = tk.words(data, bounds, 0, 2, substring_dedup.ACCEPT)
    assert w.hash[0] != w.hash[1] and w.second[0] != w.second[1]
    rows = [(k, " ".join([f"w{i}" for i in range(60)] + [x] + [f"v{i}" for i in range(60)])) for k, x in enumerate((a, b))]
    first = {r[0]: r for r in substring_dedup.brute(rows)}
    assert np.array_equal([first[0][2], first[1][2]], [0, 120])


def test_substring_dedup_parts_long_words(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [" ".join([f"w{i}" for i in range(60)] + [x] + [f"v{i}" for i in range(60)]) for x in (a, b)]
    got = substring_dedup.repeats(table(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(substring_dedup.brute(list(enumerate(rows))))


def test_decontamination_clean_beyond_the_bound(spark, texts):
    """Both ways to clean keep the same rows, those of null ids and repeated ids too."""
    bench = spark.createDataFrame([(1, texts[len(ODD)]), (2, "the same words"), (3, None), (None, "a")], "item_id long, text string")
    docs = table(spark, texts).unionAll(table(spark, texts[5:15])).unionAll(spark.createDataFrame([(None, "tie tie", "en", "s", 1, "x", 1), (None, "the same words", "en", "s", 1, "x", 1)], table(spark, ["x"]).schema))
    small, large = (sorted(map(str, decontaminate.clean(docs, bench, n).collect())) for n in (decontaminate.BLOCK_BYTES, 10))
    assert small == large and 0 < len(small) < docs.count()


def test_language_clean(spark):
    rows = [(k, "the same kind of words over and over again " * (1 + k % 3), "en" if k % 4 else None) for k in range(60)]
    rows += [(None, "words over and over", "en"), (100, None, "en"), (101, "12 34", "en"), (102, "ᚠᚢᚦᚨᚱᚲ" * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("_good0", F.lit(1))
    got = language_id.clean(docs)
    kept = got.collect()
    assert got.columns == docs.columns and len(kept) == 61
    assert {r.lang for r in kept} == {"en"} and {r.doc_id for r in kept} == {*range(60), None}


def test_chat_clashing_fields(spark):
    """Fields of another layout beside a whole one don't matter."""
    import json

    rows = spark.createDataFrame([(1, 0, "user", "q", "p", 1), (1, 1, "assistant", "a", None, 2), (None, 0, "user", None, "p", 3)], "conv_id long, turn long, role string, text string, prompt string, formatted int")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat_format.canonical(rows).collect()}
    assert got == {1: [("user", "q"), ("assistant", "a")], None: [("user", "")]}
    mixed = [{"messages": [{"role": "user", "content": "q"}], "input": "x"}, {"instruction": "i", "output": "o", "prompt": "p"}, {"prompt": "p", "answer": "a"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in mixed], "j string")
    assert [r.turns and [tuple(t) for t in r.turns] for r in chat_format.canonical_json(df, "j").collect()] == [[("user", "q")], [("user", "i"), ("assistant", "o")], None]


def test_secrets_in_prose(spark):
    """Random strings without a telling word, planted between words, paths and identifiers of the same length."""
    rng = random.Random(41)
    alphabets = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    ordinary = ["internationalisation", "src/main/java/org/example/application", "get_user_account_by_identifier", "https_proxy_configuration_2024", "abstractHttpMessageConverter2", "the-quick-brown-fox-jumps-over-1-dog", "maximum_likelihood_estimation", "Donaudampfschifffahrtsgesellschaft", "com/example/service/v2/orders/items"]
    rows, planted = [], []
    for k in range(300):
        words = [rng.choice(["we", "use", "the", "service", "with", "this", "value", "and", "then", "go"]) for _ in range(20)]
        words.insert(7, rng.choice(ordinary))
        if k % 2:
            alphabet = alphabets[k // 2 % 3]
            token = "".join(rng.choice(alphabet) for _ in range(rng.randint(24, 44)))
            words.insert(13, token if any(c.isdigit() for c in token) else token[:-1] + "7")
        planted.append(len(" ".join(words[:13])) + 1 if k % 2 else None)
        rows.append(" ".join(words))
    got = {r.doc_id: [(x["start"], x["kind"]) for x in r.spans] for r in secret_scan.scan(table(spark, rows)).collect()}
    found = sum(any(s == planted[k] for s, _ in got[k]) for k in range(300) if planted[k] is not None)
    wrong = sum(s != planted[k] for k in range(300) for s, _ in got[k])
    assert found >= 0.95 * 150 and wrong <= 3, (found, wrong)


def test_contract_columns(spark):
    """The queries' digests against the contract, read with Python's own libraries."""
    import tiktoken
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}

    def sha(x):
        return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

    for r in secret_scan.query(spark, d).collect():
        want = secret_scan.brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert r.base_sha256 == sha(",".join(f"{secret_scan.KINDS[k]}:{a}:{e}" for a, k, e in want))
    assert sorted(map(tuple, substring_dedup.query(spark, d).collect())) == sorted(substring_dedup.brute(list(texts.items())))
    for r in media_audio.query(spark, d).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]))
    held = language_id.query(spark, d).collect()
    assert len(held) == len(texts) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").selectExpr("cast(item_id as string)", "text").collect()]
    assert sorted(map(tuple, decontaminate.query(spark, d).collect())) == sorted(decontaminate.brute(list(texts.items()), items))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.VOCABULARY)), special_tokens={})
    for r in byte_bpe.query(spark, d).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))
    lib = Tokenizer.from_file(public_tokenizers.path(token_count.VOCABULARY))
    for r in token_count.query(spark, d).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    pages = html_extract.query(spark, d).collect()
    assert all(r.n_chars == len(r.text) for r in pages) and len(pages) == spark.read.parquet(f"{d}/pages.parquet").count()


def test_rows_beyond_a_slice(spark):
    """Texts over one slice of a batch are taken whole, alone or beside short ones."""
    rng = random.Random(77)
    pool = ["w%d" % k for k in range(5000)]
    long = " ".join(rng.choice(pool) for _ in range(260_000))
    rows = ["short one", long, None, long, "tail " + long[: 400_000], "short one"]
    assert len(long) > 1 << 20
    got = sorted(map(tuple, substring_dedup.repeats(table(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()))
    assert got == sorted(substring_dedup.brute(list(enumerate(rows))))
    assert class_of(spark, rows) == {0: 0, 1: 1, 2: 2, 3: 1, 4: 4, 5: 0}
    ids = {r.doc_id: bytes(r.decoded) for r in byte_bpe.encode(table(spark, rows), round_trip=True).collect()}
    assert all(ids[k] == (t or "").encode() for k, t in enumerate(rows))
    bench = spark.createDataFrame([(1, " ".join(long.split()[200_000:200_015]))], "item_id long, text string")
    hit = {r.doc_id: len(r.hit_words) for r in decontaminate.hits(table(spark, rows), bench).collect()}
    assert hit == {0: 0, 1: 15, 2: 0, 3: 15, 4: 0, 5: 0}
