"""Encoders against the tokenizers library; media, ORC and packing as exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparrowdoc.llm import bpe, orc_tokens, packing, telephony
from sparrowdoc.llm.common import default_tokenizer
from sparrowdoc.llm.encoding import ChunkEncoder

PATH = default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
ids = lambda t: LIBRARY.encode(t or "", add_special_tokens=False).ids


def hard_texts():
    rnd = random.Random(2)
    every = [f"Ab{chr(c)}b'S {chr(c)} 12{chr(c)}%" for c in [*range(1, 0x3200), 0x1F600, 0xFEFF, 0x212A, 0xAC00] if not 0xD800 <= c < 0xE000]
    runs = ["a" * 3000, "ab" * 2000, "!" * 999, "hahaha" * 80, "don't we'll I'd'", "<|startoftext|>a<|endoftext|>", "é ́x ΑΣ ς"]
    return every + runs + ["".join(rnd.choice("abehinorst") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]


@pytest.mark.parametrize("kind", [ChunkEncoder, bpe.PrefixEncoder])
def test_same_ids_as_the_library(kind):
    texts = [None, "", *hard_texts()]
    got = kind(PATH, memo_limit=500, word_limit=300).encode(pa.array(texts, pa.string())).to_pylist()
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == ids(t), t


def test_encode_and_decode(docs):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode_decode(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = ids(r.text)
        o = got[r.doc_id, len(x)]
        assert o.ids == x and o.ids_sha256 == hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
        assert o.decoded == LIBRARY.decode(x, skip_special_tokens=False) and o.decoded_sha256 == hashlib.sha256(o.decoded.encode()).hexdigest()


def test_decoded_text_of_hard_texts(spark):
    wide = ["\u00a0", "\u0085", "\u2028", "\u3000", "\u00a0\u3000"]
    texts = [None, "", *hard_texts(), *wide, *[f"a {w} b {w}{w} c" for w in wide], *[f"{w} a{w}b {w}" for w in wide], *[f"x\n{w}\ny" for w in wide]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in bpe.encode_decode(df).collect():
        x = ids(texts[r.doc_id])
        assert r.ids == x and r.decoded == LIBRARY.decode(x, skip_special_tokens=False), texts[r.doc_id]


def test_orc_rows_of_one_id_start_in_stored_order(spark, tmp_path):
    rows = [(1, "z"), (1, "a b c d e f g"), (1, None), (None, "two words"), (1, "a b c d e f g"), (2, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/orc"
    orc_tokens.write_orc(df, path)
    stored = [r for r in orc_tokens.read_orc(spark, path).orderBy("shard", "ordinal").collect()]
    assert [r.ids for r in stored] == [[*ids(t), 2] for _, t in sorted(rows, key=lambda r: (r[0] or -1, r[1] or ""))]
    at, want = 0, []
    for r in stored:
        want.append((r.doc_id or -1, at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())))
        at += len(r.ids)
    assert sorted((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32) for r in orc_tokens.catalogue(orc_tokens.read_orc(spark, path)).collect()) == sorted(want)


def test_orc_ranges_follow_the_bytes(spark, docs, monkeypatch, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d").select("doc_id", "text")
    assert orc_tokens.planned_shards(read) == orc_tokens.planned_shards(docs) == 4
    monkeypatch.setattr(orc_tokens, "SHARD_BYTES", 1000)
    assert orc_tokens.planned_shards(read) > 4 and orc_tokens.planned_shards(docs.select("doc_id", "text")) > 10


def test_orc_round_trip(spark, docs, tmp_path):
    path = f"file://{tmp_path}/orc"
    orc_tokens.write_orc(docs, path, end_id=2, shards=4)
    got = orc_tokens.catalogue(orc_tokens.read_orc(spark, path)).orderBy("doc_id", "start").collect()
    at = 0
    for r, o in zip(sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id, r.text or "")), got, strict=True):
        x = np.array([*ids(r.text), 2], "<u4")
        assert (o.doc_id, o.start, o.n_tokens, o.ids_crc32) == (r.doc_id, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    assert [r.ids for r in orc_tokens.lookup(spark, path, [27]).collect()] == [[*ids("one"), 2]]
    plan = orc_tokens.lookup(spark, path, [27])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(doc_id,27)" in plan or "In(doc_id" in plan


def test_packing(docs):
    got = packing.pack_documents(docs).collect()
    want = []
    for r in docs.select("doc_id", "text").collect():
        x = [*ids(r.text), 1]
        want += [(r.doc_id, i // 4096, i, len(x[i : i + 4096]), zlib.crc32(np.array(x[i : i + 4096], "<u4").tobytes())) for i in range(0, len(x), 4096)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_over_many_rounds(spark):
    rnd = random.Random(1)
    lengths = [rnd.randint(1, 400) for _ in range(3000)] + [rnd.randint(2049, 4096) for _ in range(300)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long").repartition(5)
    got = packing.pack(pieces, items_a_partition=100).collect()
    assert sorted(r.id for r in got) == list(range(len(lengths)))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(by) <= max(1.02 * sum(lengths) / 4096, 300) + 1
    # What can't be joined isn't: all over half.
    big = spark.createDataFrame([(i, 3000) for i in range(50)], "id long, length long")
    assert packing.pack(big, items_a_partition=10).select("sequence_id").distinct().count() == 50


def test_packing_keeps_its_bound(spark, monkeypatch):
    turns = []
    was = packing._round

    def watched(items, parts, *rest):
        placed = was(items, parts, *rest)
        turns.append((items.count(), max(r["count"] for r in items.repartition(parts, F.xxhash64("item", F.lit(rest[1]))).groupBy(F.spark_partition_id()).count().collect())))
        return placed

    monkeypatch.setattr(packing, "_round", watched)
    lengths = [2100] * 3000 + [1000] * 3
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(5)
    got = packing.pack(pieces, items_a_partition=100).collect()
    assert sorted(r.id for r in got) == list(range(3003)) and len({r.sequence_id for r in got}) <= 3001
    assert turns[0][0] == 3003 and all(most < 200 for _, most in turns) and len(turns) <= 3


def test_columns_of_the_packings_own_names(spark):
    pieces = spark.createDataFrame([(i, 10, "x", -1, -2, 3, 4) for i in range(5)], "item long, length long, bin string, sequence_id long, offset long, at int, first int")
    got = packing.pack(pieces)
    assert set(got.columns) == set(pieces.columns) and sorted(r.offset for r in got.collect()) == [0, 10, 20, 30, 40]
    assert sorted((r.item, r.bin, r.at) for r in got.collect()) == [(i, "x", 3) for i in range(5)]


def test_best_fit_is_tightest():
    placed = packing.best_fit([(1, 6), (2, 5), (3, 4), (4, 5)], 10)
    assert {i: b for i, b, _, _ in placed} == {1: 1, 2: 2, 4: 2, 3: 1}


def test_media_round_trip(docs):
    got = telephony.decode_media(telephony.store_text(docs)).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), telephony.payload_of(r.text)) for r in docs.select("doc_id", "text").collect())
    for o, (doc_id, n, payload) in zip(sorted(got, key=lambda r: (r.doc_id, r.n_bytes)), want, strict=True):
        assert (o.doc_id, o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) == (doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        sound = telephony.parse_wave(bytes(o.pcm))
        samples = len(payload) // 576 * 1145 if telephony.codec_of(payload) == "ima_adpcm" else len(payload)
        assert (sound.kind, sound.rate, len(sound.data), o.error) == (telephony.PCM, 16000, 4 * samples, None)


def test_companding_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    # Values of the G.711 standard.
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert len(set(a.tolist())) == 256


def test_adpcm_against_one_sample_at_a_time():
    rnd = np.random.default_rng(3)
    blocks = rnd.integers(0, 256, (7, telephony.BLOCK), dtype=np.uint8)
    got = telephony.decode_ima(blocks)
    steps, turn = telephony.ima_steps().tolist(), [-1, -1, -1, -1, 2, 4, 6, 8]
    for block, out in zip(blocks, got, strict=True):
        value, index = int.from_bytes(bytes(block[:2]), "little", signed=True), min(int(block[2]), 88)
        want = [value]
        for byte in block[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = steps[index]
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - move if code & 8 else value + move))
                index = max(0, min(88, index + turn[code & 7]))
                want.append(value)
        assert out.tolist() == want


@pytest.mark.parametrize("codec", ["mulaw", "alaw", "ima_adpcm"])
def test_other_codecs_keep_the_bytes(docs, codec):
    got = telephony.decode_media(telephony.store_text(docs, codec), pcm=None)
    plain = telephony.decode_media(telephony.store_text(docs), pcm=None)
    key = ["doc_id", "n_bytes", "payload_sha256"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, plain.select(key).collect()))


def test_stored_sounds(docs):
    got = {(r.doc_id, r.n_bytes): r for r in telephony.store_and_decode(docs).collect()}
    for o in telephony.decode_media(telephony.store_text(docs)).collect():
        r, pcm = got[o.doc_id, o.n_bytes], telephony.parse_wave(bytes(o.pcm)).data
        assert (r.media_sha256, r.feature, r.pcm_samples, r.pcm_crc32) == (o.media_sha256, o.feature, len(pcm) // 2, zlib.crc32(pcm))
    assert {r.feature.split(";")[0] for r in got.values()} == {"format=6", "format=7", "format=17"}


def test_pieces_of_a_long_sound(monkeypatch):
    rnd = np.random.default_rng(1)
    x = rnd.integers(-32768, 32768, 5000).astype(np.int16)
    clips = [telephony.Clip(telephony.IMA_ADPCM, 8000, 36, rnd.integers(0, 256, 36 * n, dtype=np.uint8).tobytes()) for n in (50, 0, 7)]
    whole = telephony.resample_double(x), [s.tolist() for s in telephony.samples_of(clips)], telephony.features(clips[0], x)
    for size in (1, 2, 3, 999):
        monkeypatch.setattr(telephony, "PIECE", size)
        assert (telephony.doubled(x) == whole[0]).all()
        assert [s.tolist() for s in telephony.samples_of(clips)] == whole[1] and telephony.features(clips[0], x) == whole[2]
    for sound in (x, x[:-1], whole[0], x[:1], x[:0]):
        even, rest = telephony.split_pcm(sound)
        assert (telephony.join_pcm(even, rest) == sound).all()
    assert not any(telephony.split_pcm(whole[0])[1])


def test_clips_from_elsewhere(spark):
    data = bytes(range(256)) * 9
    good = telephony.wave(data, telephony.MULAW, 16000)
    block = bytearray(telephony.wave(data, telephony.IMA_ADPCM))
    block[32:34] = (256).to_bytes(2, "little")
    stereo, slow = bytearray(good), bytearray(good)
    stereo[22], slow[24:28] = 2, (11025).to_bytes(4, "little")
    clips = [good, bytes(block), telephony.wave(data, telephony.PCM), bytes(stereo), bytes(slow), good[:100], b"", b"RIFF1234WAVE", b"RIFF1234WAVEfmt \x02\0\0\0ab", telephony.wave(data, 85), telephony.wave(data[:100], telephony.IMA_ADPCM), None]
    df = spark.createDataFrame([(i, 1, c if c is None else bytearray(c)) for i, c in enumerate(clips)], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in telephony.decode_media(df).collect()}
    assert len(telephony.parse_wave(bytes(got[0].pcm)).data) == 2 * len(data)
    assert len(telephony.parse_wave(bytes(got[1].pcm)).data) == 4 * 9 * (2 * 252 + 1)
    assert len(telephony.parse_wave(bytes(got[2].pcm)).data) == 2 * len(data)
    for i in range(3, 11):
        assert got[i].error and got[i].payload_sha256 is None and got[i].pcm is None and got[i].media_bytes == len(clips[i])
    assert got[11].error is None and got[11].media_bytes is None


def test_null_clips_and_empty_tables(spark, nothing, nulls):
    gone = spark.createDataFrame([(1, 5, None)], "doc_id long, n_bytes long, media binary")
    assert telephony.decode_media(gone).first().payload_sha256 is None
    for make in (lambda d: telephony.decode_media(telephony.store_text(d)), telephony.store_and_decode, bpe.encode_decode, packing.pack_documents, orc_tokens.store_and_catalogue):
        assert make(nothing).count() == 0
        assert make(nulls).count() == 3


def test_equal_texts_get_equal_media(docs):
    got = telephony.decode_media(telephony.store_text(docs), pcm=None).where(F.col("doc_id").isin(9, 12)).select("media_sha256", "feature").distinct()
    assert got.count() == 1
